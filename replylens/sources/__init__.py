from .tables import read_csv, read_parquet, read_table, spread, write_csv, write_json_report, write_pools
from .views import support_pairs, support_pairs_sql, transcripts

__all__ = [
    "read_csv", "read_parquet", "read_table", "spread", "write_csv", "write_json_report",
    "write_pools", "support_pairs", "support_pairs_sql", "transcripts",
]
