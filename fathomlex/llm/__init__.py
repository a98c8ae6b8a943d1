"""Operations of a large-scale training-data pipeline, as Spark DataFrame operators."""
