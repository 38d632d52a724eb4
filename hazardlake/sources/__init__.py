from .tables import (CLINICAL_SCHEMA, MOLECULAR_SCHEMA, TARGET_SCHEMA, load_clinical, load_molecular,
                     load_target, load_all, nan_to_null, read_table)
from .fixtures import fixture_tables, register_fixture_views
from .sinks import write_risk_table, write_results

__all__ = [
    "CLINICAL_SCHEMA", "MOLECULAR_SCHEMA", "TARGET_SCHEMA", "load_clinical", "load_molecular", "load_target",
    "load_all", "nan_to_null", "read_table", "fixture_tables", "register_fixture_views", "write_risk_table",
    "write_results",
]
