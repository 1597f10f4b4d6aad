"""Parameters shared by the registered queries and their SQL twins."""

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

CUTOFF = "1999-01-01 00:00:00"
SEEK = "2024-01-15 00:00:00"
REF_DAY = "2024-02-14"
DAYS_BACK = 30
CHILD_ROOT = "AMERICA"
KEY_PREFIX = "error!1"
KEY_TEXT = "!42"
GREP = "the"
REPORT_HEAD = "Live datanodes"
REQUIRED_NODES = 3
READ_SHARE = 0.3
BATCH = 10
REPORT_EVERY = 10
EXPECTED_CHILDREN = 10
TOP = 10
TAIL = 100
ONE_IN = 4
WINDOW = "10 seconds"
DELAY = "10 seconds"
BUNCHES = 5
HELD_BACK = 9
PACE = 1 << 20
