"""Incremental delivery: micro-batches of listings go through the batch operators; accepted leads and history are tables.

State is the run's tables, not a state store: a key stays known for the whole run, as it must, and survives a restart. All that a
batch writes is one commit: a batch that died leaves nothing that is read, and one that is delivered again replaces what it
wrote (H1, H5).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history as Hist, merge as M, select as S
from ..operators.tables import cut
from ..sources.commits import Commits
from ..sources.schema import LEAD_SCHEMA

_LEADS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEAD_SCHEMA) + ", lead_key string"


class Feed:
    """Takes leads until `n` are accepted. enrich: leads -> leads with the delivered fields (raw contacts validated); rules: what
    select.qualifies() asks for.

    Each batch reads what the batches before it wrote. Every `fold` batches that is gathered into one commit, and a gathered
    commit of `fold` parts into a larger one, so the commits to read stay about 2 * fold * log(batches).
    """

    def __init__(
        self, spark: SparkSession, folder: str, history: DataFrame, enrich: Callable[[DataFrame], DataFrame], n: int | None = None,
        need_email: bool = False, include_seen: bool = False, fold: int = 16, **rules: bool | str,
    ):
        self.spark, self.folder, self.history, self.enrich, self.n, self.fold = spark, folder, history, enrich, n, fold
        self.need_email, self.include_seen, self.rules = need_email, include_seen, rules
        self.full = False
        self.commits = Commits(spark, folder)

    def accepted(self, without: str | None = None) -> DataFrame:
        return self.commits.read("accepted", _LEADS, without)

    def handled(self, without: str | None = None) -> DataFrame:
        return self.commits.read("handled", "lead_key string", without)

    def remembered(self, without: str | None = None) -> DataFrame:
        """field, value that the batches add to the history: of accepted leads, and of known ones that it learned from."""
        return self.commits.read("remembered", "field string, value string", without)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: merge, drop keys handled before (H2), drop known, enrich, qualify, accept and learn, stop at n (H3)."""
        key = f"batch-{batch_id:012d}"
        before = self.accepted(key).cache()
        room = None if self.n is None else self.n - before.count()
        if room is not None and room <= 0:
            self.full = True
            before.unpersist()
            return
        rows = M.merge_leads(batch.where("name <> ''")).cache()
        history = Hist.union_history(self.history, self.remembered(key))
        own = Hist.identities(before).select("field", "value").distinct()
        fresh = rows.join(self.handled(key), "lead_key", "left_anti")
        fresh = Hist.unseen(Hist.unseen(fresh, own), history, self.need_email, self.include_seen)
        done = cut(self.enrich(fresh).where(S.qualifies(require_email=self.need_email, **self.rules)))
        done = Hist.marked(Hist.unseen(done, own), history, self.need_email, self.include_seen)  # what the run took teaches nothing
        taken, learned = map(cut, S.accept_and_learn(done, room))
        new = Hist.to_remember(taken.unionByName(learned), history)
        self.commits.commit(key, {"accepted": taken, "handled": rows.select("lead_key"), "remembered": new})
        self.commits.fold({"accepted": _LEADS, "handled": "lead_key string", "remembered": "field string, value string"}, self.fold, key)
        self.full = self.n is not None and self.accepted().count() >= self.n
        rows.unpersist()
        before.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts the feed over what is there now; a later run continues after it."""
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def run_until_full(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        query = self.run(stream, checkpoint)
        while query.isActive and not self.full:
            query.awaitTermination(1)
        if query.isActive:
            query.stop()
        elif query.exception():
            raise query.exception()
        return self.accepted()


def distinct_keys(stream: DataFrame) -> DataFrame:
    """A stream's leads, each key of a category once (H2 as a state-store operator; its state grows with the keys)."""
    return stream.dropDuplicates(["category", "lead_key"])


def unread(listings: DataFrame, read: DataFrame) -> DataFrame:
    """Listings that were not read with a detail so far may come again (H4)."""
    done = read.where("detail is not null").select("place_id")
    return listings.join(done, "place_id", "left_anti")
