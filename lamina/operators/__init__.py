"""Record operators: folds, resolution, edits, validation, reshaping."""
