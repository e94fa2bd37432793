"""Column layouts of the silver tables, as DDL. Free-form documents are VARIANT; order is always a column."""

CASES = """dataset string, case_id string, ordinal int, inputs variant, reference_outputs variant, metadata variant,
 intent string, topic string, scenario string, failure_mode string, variant string, source string,
 review_status string, review_note string, publication_id string, user_turns array<string>"""

CASE_RUNS = """run_id string, run_ordinal int, case_id string, ordinal int, response string, error string, error_class string,
 tool_calls array<struct<name:string,args:string>>, node_path array<string>"""

LEDGER = """run_id string, case_id string, seq int, tool string, args string, layer string, rule int, strategy string,
 response string, valid boolean, repairs int, fallback boolean, error string, seconds double"""

SCORES = "run_ordinal int, case_id string, metric string, outcome string, score double, comment string"

MESSAGES = "conv_id string, ordinal int, role string, content string"

REVIEW_STATES = ("pending", "approved", "rejected")
LAYERS = ("rule", "llm", "real", "fallback", "error")
MISS_POLICIES = ("real", "strict", "fallback", "llm")
SLICE_DIMS = ("intent", "failure_mode", "variant")
EMPTY = "unspecified"
