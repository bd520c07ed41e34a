"""Text-reuse analytics on Spark: find quotations of short passages in long documents."""
