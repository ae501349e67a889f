"""tidemark: DataFrame-to-DataFrame analytics for market candles, text signals and training corpora on Spark."""
