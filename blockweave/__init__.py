"""blockweave: lossless block analytics over DataFrames of binary blobs."""
