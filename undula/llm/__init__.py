"""Operations of a large-scale training-data pipeline, each over whole DataFrames."""
