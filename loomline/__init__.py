"""Log- and text-corpus analytics on Spark: structure mining, columnar encodings, chunk dedup."""
