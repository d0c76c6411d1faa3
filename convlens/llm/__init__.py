"""Operations of a training-data pipeline, kept apart from the rest of the library."""
