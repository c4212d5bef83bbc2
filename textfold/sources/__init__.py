from .io import (read_paragraphs, read_lines, read_labeled_csv, read_pairs, read_unlabeled_pairs,
                 write_table, write_predictions, read_predictions, write_fold_labels, save_predictions, load_predictions,
                 materialize_once)

__all__ = ["read_paragraphs", "read_lines", "read_labeled_csv", "read_pairs", "read_unlabeled_pairs",
           "write_table", "write_predictions", "read_predictions", "write_fold_labels", "save_predictions", "load_predictions",
           "materialize_once"]
