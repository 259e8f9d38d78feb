"""From text to Spark columns: scanning, parsing, the tree, its interpretation and its lowering."""
