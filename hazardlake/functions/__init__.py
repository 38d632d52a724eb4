from .numeric import to_number
from .text_rules import (CYTO_FLAG_RULES, ABNORMALITY_TOKEN_PATTERN, NORMAL_KARYOTYPE_PATTERN, AML_RULES,
                         AML_COUNT_PATTERN, cyto_features, aml_rule_flags, normalise_text, strip_all)

__all__ = ["to_number", "CYTO_FLAG_RULES", "ABNORMALITY_TOKEN_PATTERN",
           "NORMAL_KARYOTYPE_PATTERN", "AML_RULES", "AML_COUNT_PATTERN", "cyto_features", "aml_rule_flags",
           "normalise_text", "strip_all"]
