"""The reference application's entry points as functions over the stored
tables (``ingest.load_tables``). Each returns DataFrames; nothing is
collected here.

Serving endpoints: ``list_meetings``, ``meeting_detail``, ``dashboard``,
``competitors``, ``action_items``, ``update_action_items``, ``ask``,
``graph``. Notebook analyses: ``resolution_shift``, ``churn_risk``,
``topic_breakdown``, ``score_statistics``, ``role_sentiment``,
``action_workload``, ``degree_centrality``, ``entity_load``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import dictionaries as DICT
from ..dictionaries import DEFAULT, Dictionaries
from ..operators import actions as ACT
from ..operators import analytics as A
from ..operators import filters as FL
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import sinks as SK
from ..operators import stored as ST
from .. import schemas as S
from . import detail as DT

Tables = dict[str, DataFrame]


# ------------------------------------------------------------------ serving
def list_meetings(t: Tables, search: str | None = None, call_type: str | None = None,
                  sentiment: str | None = None, customer: str | None = None,
                  limit: int = DICT.PAGE_SIZE, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page of meetings newest first, one-row total before paging)."""
    f = dict(search=search, call_type=call_type, sentiment=sentiment, customer=customer)
    return FL.list_meetings(t["meetings"], limit=limit, offset=offset, **f), FL.count_meetings(t["meetings"], **f)


def meeting_detail(t: Tables, meeting_id: str) -> DataFrame:
    """Header and child sections of one meeting (empty when unknown)."""
    return DT.meeting_detail(t["meetings"], t["transcript_segments"], t["action_items"], t["topics"],
                             t["key_moments"], t["entities"], meeting_id=meeting_id)


def dashboard(t: Tables, d: Dictionaries = DEFAULT) -> DataFrame:
    return DT.dashboard(t["meetings"], t["topics"], d)


def competitors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(mention counts per competitor, meetings per competitor newest first)."""
    return (A.mention_counts(t["entities"], "Competitor"),
            A.competitor_meetings(t["entities"], t["meetings"]))


def action_items(t: Tables, status: str | None = None) -> DataFrame:
    return ACT.action_centre(t["action_items"], t["meetings"], status)


def update_action_items(t: Tables, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of (id, status, seq) updates applied: (new action_items, rejects)."""
    return ACT.apply_status_updates(t["action_items"], updates)


def store_action_updates(spark: SparkSession, out_dir: str, updates: DataFrame) -> DataFrame:
    """MUT1 on the stored table: only the buckets of the updated ids are
    written again. Returns the rejects."""
    return ST.merge(spark, out_dir, "action_items", updates, ACT.apply_status_updates)


def ask(spark: SparkSession, t: Tables, questions: list[tuple[int, str]], d: Dictionaries = DEFAULT):
    """Question batch -> (retrieval context, route and top titles, sources,
    ranked meetings, matching segments). Calling a language model with the
    context is left to the caller."""
    q = R.question_batch(spark, questions)
    lines = t["transcript_segments"].select("meeting_id", "turn_index", "sentence", "time", "speaker_name",
                                            "sentiment_type")
    _, ranked, segments = R.search(t["meetings"], lines, q)
    return R.context(q, ranked, segments), R.routes(q, ranked, d), R.sources(ranked), ranked, segments


def routed_answers(t: Tables, ranked: DataFrame, d: Dictionaries = DEFAULT) -> dict[str, DataFrame]:
    """The table that answers each route (in place of the reference's canned
    report text): churn -> account risk list, competitors -> competitor
    mention counts, billing and search -> the ranked meetings."""
    return {"churn": A.account_risk_top(A.account_stats(t["meetings"], d)),
            "competitors": A.mention_counts(t["entities"], "Competitor"),
            "billing": ranked, DICT.DEFAULT_ROUTE: ranked}


def graph(t: Tables, search: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the neighbourhood of matching nodes, or the
    density-limited default view."""
    if search:
        return G.neighbourhood(t["graph_nodes"], t["graph_edges"], search)
    return G.density_subgraph(t["graph_nodes"], t["graph_edges"])


def connections(t: Tables, node_id: str) -> DataFrame:
    return G.connections(t["graph_nodes"], t["graph_edges"], node_id)


# ---------------------------------------------------------------- notebooks
def resolution_shift(t: Tables) -> DataFrame:
    return A.resolution_shift(t["transcript_segments"], t["meetings"])


def churn_risk(t: Tables, d: Dictionaries = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(per-meeting churn index with tier, tier distribution)."""
    churn = A.with_risk_tier(A.churn_index(t["meetings"], A.segment_stats(t["transcript_segments"], d),
                                           A.competitor_counts(t["entities"])))
    return churn, A.tier_distribution(churn)


def topic_breakdown(t: Tables, k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(topic x call type pivot with Total, top-k topics)."""
    counts = A.topic_call_type_counts(t["topics"], t["meetings"])
    return A.topic_pivot(counts), A.topic_totals(counts, k)


def score_statistics(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(describe per call type, box-plot numbers, duration histogram,
    call-type shares)."""
    m = t["meetings"]
    return A.score_summary(m), A.box_stats(m), A.duration_histogram(m), A.share_by(m, "call_type")


def role_sentiment(t: Tables) -> tuple[DataFrame, DataFrame]:
    ct = A.crosstab(t["transcript_segments"], "speaker_role", "sentiment_type", DICT.TURN_SENTIMENTS)
    return ct, A.crosstab_share(ct, "speaker_role", DICT.TURN_SENTIMENTS)


def action_workload(t: Tables) -> tuple[DataFrame, DataFrame]:
    items = t["action_items"]
    return A.owner_workload(items), A.count_by(items, "deadline")


def degree_centrality(t: Tables) -> DataFrame:
    return G.degree_centrality(t["graph_nodes"], t["graph_edges"])


def entity_load(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(competitor mention counts, product mention counts)."""
    return A.mention_counts(t["entities"], "Competitor"), A.mention_counts(t["entities"], "Product")


def sample(t: Tables, table: str, n: int = 5) -> DataFrame:
    """First n rows of a stored table in key order."""
    return SK.sample(t[table], list(S.TABLES[table][1]), n)
