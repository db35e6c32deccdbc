from kinweave.sources.tables import corpus, distinct_rows, load_table, read_csv, sampled, with_row_index, write_csv

__all__ = ["corpus", "distinct_rows", "load_table", "read_csv", "sampled", "with_row_index", "write_csv"]
