from surveylab.streaming.score_stream import score_stream, run_to_table  # noqa: F401
