"""leafgate: long-form text preparation and silence-gated stream segmentation on PySpark."""
