"""Declared schemas; nothing is inferred."""

MESSAGES = "array<struct<role: string, content: string>>"
RECORD = f"key string, mode string, register string, system string, input string, output string, messages {MESSAGES}"
FIELDS = ["key", "mode", "register", "system", "input", "output", "messages"]
SEED = "id string, text string"
SENTENCE = "id string, text string, theme string"
WEB_SOURCE = "id string, text string, register string"
PROGRESS = "key string, status string, output string"
REJECTED = "key string, mode string, reason string, candidate string, input string"
LEDGER_ENTRY = "key string, digest string, categories array<string>, note string"
HISTORY = "id string, title string, input string, output string, modeId string, engine string, at bigint"
DELTA = "request_id string, seq bigint, text string, done boolean, error string"
DICTATION = "session bigint, result_index int, is_final boolean, transcript string"
