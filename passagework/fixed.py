"""Inputs, limits, markers and texts that results depend on."""

# --- fixed values: ingest ---------------------------------------------------
LINK_COLUMN_PREFIX = "wikipedia_link_"
LINK_COLUMN_COUNT = 11
TITLE_MAX_CHARS = 255
CONTENT_ROOT_ID = "mw-content-text"
HEADING_BLOCK_CLASS = "mw-heading"
REMOVED_DIV_CLASSES = ("navbox", "reference")
NOTE_ROW_CLASS = "sortbottom"
SKIPPED_HEADINGS = (
    "See also",
    "Notes",
    "References",
    "External links",
    "Citations",
    "Works cited",
    "Bibliography",
)
MEDIA_LINK_PREFIXES = ("File", "Image", "Media")

# --- fixed values: chunks and vectors ---------------------------------------
CHUNK_TOKENS = 7600
VECTOR_DIM = 1536
CHUNK_EMBED_BATCH = 20
TITLE_EMBED_BATCH = 100

# --- fixed values: retrieval ------------------------------------------------
TOP_K_CHUNKS = 5
TOP_K_ARTICLES = 5
TOP_K_ARTICLES_TOOL = 3
MAX_TOOL_ROUNDS = 5
HIT_HEADER = "Related content %d (similarity: %.2f):\n"
PROMPT_OPENING = "Here is some relevant context that might help answer the query:"
PROMPT_REQUEST = "Based on the above context and your knowledge, please answer this query:"
ROUND_LIMIT_MESSAGE = (
    "You have reached the maximum number of tool uses. "
    "Please provide a final response based on the information you have gathered so far."
)
TOO_LONG = "prompt is too long"
