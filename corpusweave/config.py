"""Constants whose values must equal the behaviour being matched.

Fixed values (kept together, in natural order):
  top-k of semantic search ........ 10
  context budget (symbols) ........ 30
  graph expansion depth ........... 2
  hop score ........................ 1.0 - 0.2 * hop, never below 0
  default score of a graph chunk .. 0.5
  embedding batch (texts) ......... 300
  retry-loop limit (test -> dev) .. 3
  API attempts ..................... 3, wait 5 * (attempt + 1) seconds
  failure tail in prompt (chars) .. 3000
  short error (chars) ............. 200
  log display tail (chars) ........ 500
"""

TOP_K = 10
MAX_SYMBOLS = 30
BFS_DEPTH = 2
HOP_DECAY = 0.2
GRAPH_DEFAULT_SCORE = 0.5
EMBED_BATCH = 300
MAX_RETRIES = 3
API_ATTEMPTS = 3
API_WAIT_STEP_S = 5
FAILURE_TAIL_CHARS = 3000
SHORT_ERROR_CHARS = 200
LOG_DISPLAY_CHARS = 500
MODULE_LEVEL_NAME = "__module_level__"
