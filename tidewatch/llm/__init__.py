"""Operations of training-data pipelines over documents and pages; their queries are in `queries`."""
