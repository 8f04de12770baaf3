from surveylab.sources.io import (  # noqa: F401
    scan_filtered, read_table, require_columns, codebook, value_labels,
    rename_by_dictionary, write_table, write_split, save_model, load_model,
    write_run_metadata, union_all, load_tables, feature_list,
)
