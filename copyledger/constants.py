"""Fixed values the results depend on.

Everything in the FIXED VALUES block must stay equal to the behaviour being
reproduced: changing any of them changes which files are catalogued, which
bytes are fingerprinted, or how names and numbers are rendered.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the catalogued behaviour exactly)
# ---------------------------------------------------------------------------

# Video file extensions accepted by the scan (compared case-insensitively with
# the last suffix of the file name).
VIDEO_EXTENSIONS = (
    ".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v",
    ".3gp", ".ogv", ".mts", ".m2ts", ".ts", ".vob", ".asf", ".rm",
    ".rmvb", ".divx", ".xvid", ".mpg", ".mpeg", ".m2v", ".mpe",
)

# Sampled fingerprint: files below the threshold are hashed whole, larger
# files are hashed as md5(md5(first) || md5(middle) || md5(last)) of chunks.
HASH_CHUNK_SIZE = 1024
HASH_MIN_SIZE_FOR_MULTI_CHUNK = 5120

# Characters replaced by "_" when a name is placed in the canonical store,
# and the maximum name length kept (the extension is preserved).
SANITIZE_CHARS = "/\\<>:\"|?*"
SANITIZED_NAME_MAX = 200

# A link whose relative target contains this many ".." (substring count) or
# more is refused.
MAX_LINK_DOTDOTS = 20

# Canonical store layout: files/{h[0:2]}/{h[2:4]}/{hash}_{name}; files
# without a hash go to 00/00/no_hash_{name}.
STORE_SUBDIR = "files"
NO_HASH_PREFIX1 = "00"
NO_HASH_PREFIX2 = "00"
NO_HASH_PART = "no_hash"

# Domains of the catalog's text columns.
STATUS_PENDING = "not_processed"
STATUS_DONE = "deduplicated"
PATH_ORIGINAL = "original"
PATH_CONSOLIDATED = "consolidated"
PATH_SYMLINK = "symlink"

DEDUP_COUNTER_KEYS = ("files_deduplicated", "symlinks_created", "files_consolidated")

# Byte-size units for human-readable sizes (divide by 1024 per step).
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
BYTE_UNIT_LAST = "PB"

# Default length of the top-k project lists and of the error list.
TOP_K_DEFAULT = 10
ERRORS_SHOWN = 10

# ---------------------------------------------------------------------------
# Plan actions (our output vocabulary)
# ---------------------------------------------------------------------------
ACTION_KEEP = "keep"
ACTION_LINK = "link"
ACTION_ALREADY_DONE = "already_done"
ACTION_MISSING = "missing"
ACTION_TOO_DEEP = "too_deep"
ACTION_ORPHAN_GROUP = "orphan_group"
ACTION_NO_COPY = "no_master_copy"
ACTION_UNREADABLE = "unreadable"
ERROR_ACTIONS = (ACTION_MISSING, ACTION_TOO_DEEP, ACTION_ORPHAN_GROUP, ACTION_NO_COPY, ACTION_UNREADABLE)
