"""Declared schemas of the records the operators read."""

DOCUMENT = "doc_id bigint, page bigint, text string, lang string, source string, n_chars bigint"
MESSAGE = "conv_id bigint, turn bigint, role string, text string"
EVENT = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)

TOOL_CALLS = "array<struct<name:string,args:map<string,string>,id:string>>"
SOURCE_MAP = "id int, sources array<map<string,string>>"

# Options stay a map so that a missing key and an explicit null can be told apart.
REQUEST = "question string, options map<string,string>"

FAQ_SIDE = "struct<text:string,comic:string,poster:string>"
FAQ_FILE = f"map<string,struct<lawyer:{FAQ_SIDE},normal:{FAQ_SIDE}>>"

SCENARIO = (
    "id int, name string, difficulty int, difficultyLabel string, duration int, "
    "skills array<string>, description string, summary string, facts array<string>"
)

# Fields of a session document, in the order the stages write them.
SESSION_FIELDS = [
    "scenarioId",
    "role",
    "coach",
    "objective",
    "settings",
    "strategy",
    "completed",
    "timeRemaining",
    "roundsCompleted",
    "messages",
]
