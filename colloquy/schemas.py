"""Schemas of the raw meeting bundles and of the target tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ----- raw bundle files (one folder per meeting) -----
MEETING_INFO = _struct(
    ("meetingId", S), ("title", S), ("organizerEmail", S), ("host", S),
    ("startTime", S), ("endTime", S), ("duration", D),
    ("allEmails", T.ArrayType(S)), ("invitees", T.ArrayType(S)),
)
KEY_MOMENT = _struct(("time", D), ("text", S), ("type", S), ("speaker", S))
SUMMARY = _struct(
    ("meetingId", S), ("summary", S), ("actionItems", T.ArrayType(S)),
    ("topics", T.ArrayType(S)), ("overallSentiment", S), ("sentimentScore", D),
    ("keyMoments", T.ArrayType(KEY_MOMENT)),
)
TRANSCRIPT_TURN = _struct(
    ("sentence", S), ("speaker_name", S), ("sentimentType", S), ("time", D),
    ("endTime", D), ("averageConfidence", D), ("index", I),
)
TRANSCRIPT = _struct(("data", T.ArrayType(TRANSCRIPT_TURN)))
SPEAKER = _struct(("speakerName", S), ("timestamp", D), ("endTimeTs", D))
PARTICIPATION_EVENT = _struct(("participantName", S), ("timestamp", L), ("type", S), ("time", D))

# file name -> (schema, is the document root an array?)
BUNDLE_FILES = {
    "summary.json": (SUMMARY, False),
    "meeting-info.json": (MEETING_INFO, False),
    "speakers.json": (SPEAKER, True),
    "events.json": (PARTICIPATION_EVENT, True),
    "speaker-meta.json": (None, False),   # root map with dynamic keys, read as text
    "transcript.json": (TRANSCRIPT, False),
}
# Order in which the completeness gate reports the first missing file.
REQUIRED_FILES = ("summary.json", "meeting-info.json", "speakers.json", "events.json",
                  "speaker-meta.json", "transcript.json")

# ----- target tables -----
TS = T.TimestampNTZType()
MEETINGS = _struct(
    ("meeting_id", S), ("title", S), ("organizer_email", S), ("host", S),
    ("start_time", TS), ("end_time", TS), ("duration", D), ("summary", S),
    ("overall_sentiment", S), ("sentiment_score", D), ("call_type", S),
)
TRANSCRIPT_SEGMENTS = _struct(
    ("id", S), ("meeting_id", S), ("sentence", S), ("speaker_name", S),
    ("speaker_role", S), ("sentiment_type", S), ("time", D), ("end_time", D),
    ("average_confidence", D), ("turn_index", I),
)
ACTION_ITEMS = _struct(("id", S), ("meeting_id", S), ("task", S), ("owner", S),
                       ("deadline", S), ("status", S))
TOPICS = _struct(("meeting_id", S), ("topic", S))
KEY_MOMENTS = _struct(("id", S), ("meeting_id", S), ("time", D), ("text", S),
                      ("type", S), ("speaker", S))
ENTITIES = _struct(("meeting_id", S), ("entity_name", S), ("entity_type", S))
GRAPH_NODES = _struct(("id", S), ("label", S), ("type", S))
GRAPH_EDGES = _struct(("source", S), ("target", S), ("relation", S))

TABLES = {
    "meetings": (MEETINGS, ("meeting_id",)),
    "transcript_segments": (TRANSCRIPT_SEGMENTS, ("id",)),
    "action_items": (ACTION_ITEMS, ("id",)),
    "topics": (TOPICS, ("meeting_id", "topic")),
    "key_moments": (KEY_MOMENTS, ("id",)),
    "entities": (ENTITIES, ("meeting_id", "entity_name", "entity_type")),
    "graph_nodes": (GRAPH_NODES, ("id",)),
    "graph_edges": (GRAPH_EDGES, ("source", "target", "relation")),
}
