"""Check names, report texts and example limits that readers of the results rely on."""

RECORD_COUNT = "record_count_check"
COLUMN_COUNT = "column_count_check"
METADATA_TYPE = "metadata_type_check"
DUPLICATE = "duplicate_check"
NULLS = "null_check"
EMPTY_STRING = "empty_string_check"
KEY_MATCH = "primary_key_match"
DATA = "data_validation"
COLUMN_ORDER = "column_order_check"
COLUMN_LENGTH = "column_length_check"
COLUMN_PRECISION = "column_precision_check"
COLUMN_SPECS = "column_specs_check"
DISTINCT = "distinct_value_check"
DATE_RANGE = "date_range_check"
CASE = "case_sensitivity_check"
LEADING_ZERO = "leading_zero_check"
SPECIAL_CHAR = "special_char_check"
CHECKSUM = "checksum_check"
SYMMETRIC = "symmetric_difference_check"

DUPLICATE_EXAMPLES = 5
EMPTY_EXAMPLES = 3
KEY_EXAMPLES = 5
VALUE_EXAMPLES = 3
POSITION_EXAMPLES = 100
CHECKSUM_EXAMPLES = 5
HASH_DIGITS = 16

SUBSET_NOTE = " (Note: Smart sub-setting applied - records filtered to matching PKs)"
ROW_COUNTS = "Source: {s} rows, Target: {t} rows"
COLUMN_COUNTS = "Source: {s} columns, Target: {t} columns, Common: {c}"
SOURCE_ONLY_COLUMNS = "Source-only: {names}"
TARGET_ONLY_COLUMNS = "Target-only: {names}"
TYPES_COMPATIBLE = "Compatible types: Source '{s}', Target '{t}'"
TYPES_INCOMPATIBLE = "Incompatible types: Source '{s}', Target '{t}'"

NO_KEY_DUPLICATES = "No primary key defined - duplicate check skipped"
KEY_NOT_FOUND_DUPLICATES = (
    "Primary key columns {keys} not found in both source and target - duplicate check skipped"
)
NO_DUPLICATES = "No duplicates found in {side}"
DUPLICATES = "%s has %d duplicate rows (showing first 5 of %d)"

NULL_COUNTS = "Source: %d nulls, Target: %d nulls"
NO_NULLS = "No null values found in any common columns"
EMPTY_FOUND = "%s contains empty string (showing first 3 of %d)"
NO_EMPTY = "No empty strings found"

KEY_COUNTS = "Common: {c}, Source-only: {s}, Target-only: {t}"
KEY_ONE_SIDED = "Primary key exists in {here} but not in {there} (showing first 5 of {n})"
KEY_COLUMNS_MISSING = "Primary key columns missing. Source: {s}, Target: {t}"
COLUMN_MISMATCHES = "%d mismatches in column %s"
VALUE_MISMATCH = "Value mismatch (example %d of %d)"
ALL_VALUES_MATCH = "All values match for {k} common records across {c} columns"
POSITION_MISMATCH = "Values do not match"
MORE_POSITIONS = "... and %d more mismatches (showing first 100)"
ALL_POSITIONS_MATCH = "All {n} rows match across {c} common columns"

ORDER_DIFFERS = "Column order differs"
ORDER_MATCHES = "Column order matches"
LENGTH_DIFFERS = "Length mismatch in column {c}"
PRECISION_DIFFERS = "Precision/Scale mismatch: {s} vs {t}"
SPECS_MATCH = "All column specifications match"
DISTINCT_DIFFERS = "Distinct value count differs"
DISTINCT_MATCHES = "All columns have matching distinct value counts"
DATES_DIFFER = "Date range mismatch"
DATES_MATCH = "All date ranges match"
DATE_RANGE_TEXT = "%s to %s"

CASE_DIFFERS = "Case difference detected: '%s' vs '%s'"
CASE_MATCHES = "No case sensitivity mismatches found"
ZERO_DIFFERS = "Leading zero mismatch: '%s' vs '%s'"
ZERO_MATCHES = "No leading zero mismatches found"
SPECIAL_DIFFERS = "Special/Unicode character difference detected"
SPECIAL_MATCHES = "No special character integrity issues found"
CHECKSUM_DIFFERS = "Row checksum mismatch"
CHECKSUMS_MATCH = "All {n} row checksums match"
MORE_CHECKSUMS = "... and %d more checksum mismatches"
NO_KEY = "No primary key defined"
SYMMETRIC_COUNTS = "Symmetric difference: {n} records (Source-only: {s}, Target-only: {t})"

# Texts of this engine.
KEY_REDUCED = "Only key columns {used} of {configured} exist on both sides and were used"
SUBSET_REMOVED = "Smart sub-setting removed {n} rows from {side}"
