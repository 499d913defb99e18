"""The change feed as batch operators: validation, last write wins, sequence numbers, pages, and the client's side.

Arrivals are ordered by (push, patients before encounters, ord).  A record is accepted if it is strictly newer than
everything that its key has seen: a rejected record never raises that maximum, so a running maximum decides exactly
what one-by-one processing would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispensary.functions.text import trim
from dispensary.operators.store import dirty
from dispensary.session import shared_folder

#: Records in a page, and bytes in a request.
PAGE_SIZE, BODY_BYTES = 500, 8 << 20

KEY = ("facilityId", "kind", "id")


def valid(id_: Column, updated_at: Column) -> Column:
    """An id of 1 to 128 characters and a finite change time."""
    return F.coalesce(F.length(id_).between(1, 128) & ~F.isnan(updated_at) & (F.abs(updated_at) < float("inf")), F.lit(False))


def clean_facility(facility: Column) -> Column:
    """The trimmed facility, null if it is empty or longer than 128 characters."""
    f = trim(facility)
    return F.when(F.length(f).between(1, 128), f)


def clean_cursor(cursor: Column, kind: Column | None = None) -> Column:
    """The cursor as a number, 0 if it isn't a finite one, or if its JSON `kind` is known and is no number: a string never is."""
    c = cursor.try_cast("double")
    if kind is not None:
        c = F.when(kind.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), c)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0)).otherwise(c).cast("long")


def parse_requests(lines: DataFrame, column: str = "value", most_bytes: int = BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(changes, rejected lines) of sync requests as JSON lines: facilityId, cursor, push and changes of both kinds.

    Each change carries its request's cursor.  Records that aren't objects with an id that is a string, and a change time, are
    dropped; lines that aren't JSON, have no facility or are longer than `most_bytes` are rejected."""
    parsed, rejected = _parsed(lines, column, most_bytes)
    kinds = F.array(F.struct(F.lit("patient").alias("kind"), F.col("r.changes.patients").alias("list")), F.struct(F.lit("encounter").alias("kind"), F.col("r.changes.encounters").alias("list")))
    per = parsed.select("facilityId", "cursor", "push", F.explode(kinds).alias("k"))
    rows = per.select("facilityId", "cursor", "push", "k.kind", F.posexplode("k.list").alias("ord", "body"))
    id_kind = F.schema_of_variant(F.variant_get(F.try_parse_json("body"), "$.id", "variant"))
    fields = F.from_json("body", "id string, updatedAt double, deletedAt long")
    rows = rows.filter(id_kind == "STRING").withColumn("f", fields).select("facilityId", "cursor", "push", "ord", "kind", F.col("f.id").alias("id"), F.col("f.updatedAt").alias("updatedAt"), F.col("f.deletedAt").alias("deletedAt"), "body")
    return rows.filter(valid(F.col("id"), F.col("updatedAt"))), rejected


def request_heads(lines: DataFrame, column: str = "value", most_bytes: int = BODY_BYTES) -> DataFrame:
    """(facilityId, push, cursor) of every request that is answered, also of those without a valid record."""
    return _parsed(lines, column, most_bytes)[0].select("facilityId", "push", "cursor")


def _parsed(lines: DataFrame, column: str, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    schema = "facilityId string, cursor string, push long, changes struct<patients: array<string>, encounters: array<string>>"
    parsed = lines.select(F.col(column).alias("line"), F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r.facilityId").isNull() | clean_facility(F.col("r.facilityId")).isNull() | (F.octet_length("line") > most_bytes)
    cursor_kind = F.schema_of_variant(F.variant_get(F.try_parse_json("line"), "$.cursor", "variant"))
    good = parsed.filter(~bad).select(clean_facility(F.col("r.facilityId")).alias("facilityId"), clean_cursor(F.col("r.cursor"), cursor_kind).alias("cursor"), F.col("r.push").alias("push"), "r")
    return good, parsed.filter(bad).select("line")


def judged(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The valid changes with `accepted`, `serverUpdatedAt` (the newest before it) and `rank` (its place in the push).

    A key's rows meet in one sorted partition and are streamed through a running maximum; nothing is gathered."""
    c = changes.filter(valid(F.col("id"), F.col("updatedAt"))).withColumn("rank", F.struct(F.when(F.col("kind") == "patient", 0).otherwise(1).alias("kindOrder"), F.col("ord").alias("ord")))
    before = Window.partitionBy(*KEY).orderBy("push", "rank").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("updatedAt").over(before)
    if state is not None:
        held = state.select(*KEY, F.col("updatedAt").alias("held"))
        c, seen = c.join(held, list(KEY), "left"), F.greatest(seen, F.col("held"))
    c = c.withColumn("serverUpdatedAt", seen)
    return c.withColumn("accepted", F.col("serverUpdatedAt").isNull() | (F.col("updatedAt") > F.col("serverUpdatedAt"))).drop("held")


def conflicts(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """What the server refuses, and the change time that it has."""
    return judged(changes, state).filter(~F.col("accepted")).select("facilityId", "push", "kind", "id", F.lit("server_newer").alias("reason"), "serverUpdatedAt")


def _places(accepted: DataFrame) -> DataFrame:
    """The rows with `part`, a range of facility, push and rank, and `row`, which rises by one within it.  Written down, as ranges are drawn
    from a sample."""
    ranged = accepted.repartitionByRange("facilityId", "push", "rank").sortWithinPartitions("facilityId", "push", "rank")
    shared_folder(accepted.sparkSession)
    ranged = ranged.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    return ranged.withColumn("part", F.shiftright("row", 33))


def sequenced(changes: DataFrame, state: DataFrame | None = None, counters: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """The accepted changes with their `seq`.

    A push moves its facility's counter by all its valid records, and its accepted records take the numbers from there
    on, so conflicts leave gaps.  Counters are sums over pushes: a facility's pushes are few against its records.  `wide` is for
    pushes of any size: one is numbered in ranges, by many tasks."""
    j = judged(changes, state)
    per_push = j.groupBy("facilityId", "push").agg(F.count("*").alias("valid"))
    base = F.coalesce(F.sum("valid").over(Window.partitionBy("facilityId").orderBy("push").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_push = per_push.withColumn("base", base)
    if counters is not None:
        per_push = per_push.join(counters.select("facilityId", F.col("value").alias("start")), "facilityId", "left").withColumn("base", F.col("base") + F.coalesce("start", F.lit(0)))
    per_push = per_push.select("facilityId", "push", "base")
    if wide:
        rows = _places(j.filter("accepted"))
        parts = rows.groupBy("facilityId", "push", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
        earlier = Window.partitionBy("facilityId", "push").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        parts = parts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1)
        parts = parts.join(per_push.withColumnRenamed("base", "start"), ["facilityId", "push"]).select("facilityId", "push", "part", (F.col("base") + F.col("start")).alias("base"))
        a = rows.join(parts, ["facilityId", "push", "part"])
        return a.withColumn("seq", F.col("base") + F.col("row")).drop("base", "part", "row", "rank", "accepted", "serverUpdatedAt")
    a = j.filter("accepted").join(per_push, ["facilityId", "push"])
    place = F.row_number().over(Window.partitionBy("facilityId", "push").orderBy("rank"))
    return a.withColumn("seq", F.col("base") + place).drop("base", "rank", "accepted", "serverUpdatedAt")


def counters_after(changes: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """(facilityId, value)"""
    c = changes.filter(valid(F.col("id"), F.col("updatedAt"))).groupBy("facilityId").agg(F.count("*").alias("value"))
    if counters is not None:
        c = c.unionByName(counters.select("facilityId", "value")).groupBy("facilityId").agg(F.sum("value").alias("value"))
    return c


def apply_push(changes: DataFrame, state: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """The record store after the changes: of each key the last accepted version, with its sequence number."""
    return _stored(sequenced(changes, state, counters), state)


def _stored(accepted: DataFrame, state: DataFrame | None) -> DataFrame:
    new = accepted.select("facilityId", "kind", "id", "updatedAt", "deletedAt", "seq", "body")
    if state is not None:
        new = new.unionByName(state.select(new.columns))
    # versions of a key rise in both time and number, so the latest is the maximum; combined map-side
    row = F.struct("updatedAt", "seq", "deletedAt", "body")
    return new.groupBy(*KEY).agg(F.max_by(row, F.struct("updatedAt", "seq")).alias("r")).select(*KEY, "r.updatedAt", "r.deletedAt", "r.seq", "r.body")


def pull(state: DataFrame, facility: str, cursor: int, page: int = PAGE_SIZE) -> DataFrame:
    """The next page of a facility's records after the cursor, by sequence number."""
    return state.filter((F.col("facilityId") == F.lit(facility)) & (F.col("seq") > cursor)).orderBy("seq").limit(page).select("kind", "id", "body", "seq")


def page_facts(page_rows: DataFrame, cursor: int, page: int = PAGE_SIZE) -> DataFrame:
    """(cursor, hasMore, records), one row"""
    return page_rows.agg(F.coalesce(F.max("seq"), F.lit(cursor)).alias("cursor"), (F.count("*") == page).alias("hasMore"), F.count("*").alias("records"))


# --- many requests at once ------------------------------------------------------------------------------------------


def versions(changes: DataFrame, state: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """Every version of every record with the pushes after which a facility's pull shows it: from `since` until before `until`.

    A version is followed by its key's next accepted one; what `state` holds was there before all pushes (since is null)."""
    new = sequenced(changes, state, counters).select("facilityId", "kind", "id", "seq", F.col("push").alias("since"), "body")
    if state is not None:
        new = new.unionByName(state.select("facilityId", "kind", "id", "seq", F.lit(None).cast("long").alias("since"), "body"))
    return new.withColumn("until", F.lead("since").over(Window.partitionBy(*KEY).orderBy("seq")))


#: Sequence numbers in a block of versions, blocks in a run, and requests and pushes in a slab.
BLOCK, RUN, REQUESTS = 2048, 8, 4096

_LATE = (1 << 63) - 1
#: The push of what was there before all pushes.
_FIRST = -(1 << 62)
_PAIR = "facilityId string, push long, cursor long, upto long, slab long, run long"
#: Blocks of which a request looks at the counts at once.
_LOOK = 512


def _times(requests: DataFrame, shown: DataFrame) -> DataFrame:
    """(facilityId, push, asks, upto, slab, end): a row a request and a row a push that shows something, with the newest number that is shown
    by then; slabs count up to REQUESTS of both, in the order of pushes, until `end`."""
    own = shown.groupBy("facilityId", F.coalesce("since", F.lit(_FIRST)).alias("push")).agg(F.max("seq").alias("seq")).withColumn("asks", F.lit(False))
    marks = requests.select("facilityId", "push", F.lit(None).cast("long").alias("seq"), F.lit(True).alias("asks")).unionByName(own)
    by_then = Window.partitionBy("facilityId").orderBy("push")  # with all of the same push; a row a push
    marks = marks.select("facilityId", "push", "asks", F.max("seq").over(by_then).alias("upto"), F.floor(F.count("*").over(by_then) / REQUESTS).alias("slab"))
    return marks.withColumn("end", F.max("slab").over(Window.partitionBy("facilityId")))


def _steps(shown: DataFrame, times: DataFrame) -> DataFrame:
    """(facilityId, slab, push, block, n): how many versions a block has at the beginning of a slab (its push is before all), and what
    each push of the slab adds or takes away.

    Blocks that have nothing are not listed, so what has long been followed costs nothing, however far behind a cursor is."""
    moves = shown.select("facilityId", F.coalesce("since", F.lit(_FIRST)).alias("push"), "block", F.lit(1).alias("n"))
    moves = moves.unionByName(shown.filter("until is not null").select("facilityId", F.col("until").alias("push"), "block", F.lit(-1).alias("n")))
    moves = moves.groupBy("facilityId", "push", "block").agg(F.sum("n").alias("n")).filter("n <> 0")
    moves = moves.join(times.filter("not asks").select("facilityId", "push", "slab", "end"), ["facilityId", "push"])
    slabs = Window.partitionBy("facilityId", "block").orderBy("slab")
    held = moves.groupBy("facilityId", "block", "slab", "end").agg(F.sum("n").alias("n"))
    held = held.select("facilityId", "block", "slab", F.sum("n").over(slabs).alias("n"), F.coalesce(F.lead("slab").over(slabs), "end").alias("until")).filter("n > 0 and until > slab")
    held = held.select("facilityId", F.explode(F.sequence(F.col("slab") + 1, "until")).alias("slab"), F.lit(-_LATE).alias("push"), "block", "n")
    return held.unionByName(moves.select(*[F.col(c).alias(c) for c in held.columns]))


def _meet(pairs: DataFrame, shown: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """run(pairs, versions of their run of blocks), as tables, for each run and slab: one group holds no more than RUN blocks' versions, and of
    these what a request of the slab may see, and REQUESTS requests, however many there are of both."""
    met = pairs.groupBy(F.col("facilityId").alias("f"), F.col("run").alias("r"), F.col("slab").alias("s")).agg(F.min("push").alias("low"), F.max("push").alias("high"))
    own = shown.select("facilityId", F.floor(F.col("block") / RUN).alias("run"), "seq", F.coalesce("since", F.lit(-_LATE)).alias("since"), F.coalesce("until", F.lit(_LATE)).alias("until"), *columns)
    seen = (F.col("facilityId") == F.col("f")) & (F.col("run") == F.col("r")) & (F.col("until") > F.col("low")) & (F.col("since") <= F.col("high"))
    own = own.join(met, seen).withColumn("slab", F.col("s")).drop("f", "r", "s", "low", "high")
    group = ["facilityId", "run", "slab"]
    return pairs.groupBy(*group).cogroup(own.groupBy(*group)).applyInArrow(run, schema)


def _alive(pairs: pa.Table, versions: pa.Table) -> tuple[pa.Table, Iterator[np.ndarray]]:
    """The versions by seq, and of each request the places of those that it is to be sent out of this block."""
    versions = versions.sort_by("seq")
    seq, since, until = (versions.column(c).to_numpy() for c in ("seq", "since", "until"))
    push, cursor, upto = (pairs.column(c).to_numpy() for c in ("push", "cursor", "upto"))
    first, stop = np.searchsorted(seq, cursor, "right"), np.searchsorted(seq, upto, "right")
    return versions, (a + np.flatnonzero((until[a:b] > p) & (since[a:b] <= p)) for p, a, b in zip(push, first, stop, strict=True))


def _reached(requests: DataFrame, shown: DataFrame, page: int, last: bool = False) -> DataFrame:
    """(facilityId, push, cursor, upto, slab, run, before): the runs of blocks that a request is sent versions from, up to what number, and how many
    it has from earlier ones; of each request only the last with `last`.

    Of the block that the cursor is in, versions are counted.  Blocks behind it count as wholes: a slab begins with the counts of all blocks that have
    something, its pushes change them in turn, and each request takes those that it finds until its page is full."""
    times, block, run_ = _times(requests, shown), BLOCK, RUN
    asked = requests.join(times.filter("asks").select("facilityId", "push", "upto", "slab"), ["facilityId", "push"]).filter("upto > cursor")
    asked = asked.select("facilityId", "push", "cursor", "upto", "slab", F.floor(F.greatest("cursor", F.lit(0)) / BLOCK).alias("begin"))

    def count(pairs: pa.Table, versions: pa.Table) -> pa.Table:
        n = np.fromiter((len(x) for x in _alive(pairs, versions)[1]), np.int64, pairs.num_rows) if versions.num_rows else np.zeros(pairs.num_rows, np.int64)
        return pairs.select(["facilityId", "push"]).append_column("n", pa.array(n)).filter(pa.array(n > 0))

    def sweep(asks: pa.Table, steps: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if asks.num_rows and steps.num_rows:
            asks, steps = asks.sort_by("push"), steps.sort_by("push")
            push, upto, begin, n = (asks.column(c).to_numpy() for c in ("push", "upto", "begin", "n"))
            blocks, at = np.unique(steps.column("block").to_numpy(), return_inverse=True)
            moved, has = steps.column("n").to_numpy(), np.zeros(len(blocks), np.int64)
            due, first, stop = np.searchsorted(steps.column("push").to_numpy(), push, "right"), np.searchsorted(blocks, begin, "right"), np.searchsorted(blocks, upto // block, "right")
            done = 0
            for k in range(len(push)):
                if due[k] > done:
                    np.add.at(has, at[done : due[k]], moved[done : due[k]])
                    done = due[k]
                seen, own, before = n[k], [begin[k : k + 1][: n[k]]], [np.zeros(min(n[k], 1), np.int64)]
                for a in range(first[k], stop[k], _LOOK):
                    if seen >= page:
                        break
                    here = has[a : min(a + _LOOK, stop[k])]
                    some = np.flatnonzero(here)
                    sums = seen + np.cumsum(here[some])
                    some = some[: np.searchsorted(sums, page) + 1]  # until the page is full
                    own.append(blocks[a + some])
                    before.append(sums[: len(some)] - here[some])
                    seen = sums[-1] if len(sums) else seen
                own, before = np.concatenate(own), np.concatenate(before)
                if len(own):
                    runs = own // run_
                    ends = np.append(np.flatnonzero(np.diff(runs)), len(own) - 1)
                    starts = np.append(0, ends[:-1] + 1)
                    if last:
                        starts, ends = starts[-1:], ends[-1:]
                    rows.append((np.full(len(ends), k), np.minimum((own[ends] + 1) * block - 1, upto[k]), runs[ends], before[starts]))
        which, upto, runs, before = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 4
        asks = asks.select(["facilityId", "push", "cursor", "slab"]).take(pa.array(which))
        return pa.table({"facilityId": asks.column(0), "push": asks.column(1), "cursor": asks.column(2), "upto": pa.array(upto), "slab": asks.column(3), "run": pa.array(runs), "before": pa.array(before)})

    of_begin = asked.select("facilityId", "push", "cursor", F.least("upto", (F.col("begin") + 1) * BLOCK - 1).alias("upto"), "slab", F.floor(F.col("begin") / RUN).alias("run"))
    counted = _meet(of_begin, shown, [], count, "facilityId string, push long, n long")
    asked = asked.join(counted, ["facilityId", "push"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    group = ["facilityId", "slab"]
    return asked.groupBy(*group).cogroup(_steps(shown, times).groupBy(*group)).applyInArrow(sweep, f"{_PAIR}, before long")


def _shown(changes: DataFrame, state: DataFrame | None, counters: DataFrame | None) -> DataFrame:
    """The versions that a pull can show, by blocks of sequence numbers; made once."""
    shown = versions(changes, state, counters).withColumn("block", F.floor(F.col("seq") / BLOCK)).filter("since is null or until is null or until > since")
    shared_folder(changes.sparkSession)
    return shown.checkpoint()


def pages(requests: DataFrame, changes: DataFrame, state: DataFrame | None = None, counters: DataFrame | None = None, page: int = PAGE_SIZE) -> DataFrame:
    """(facilityId, push, place, kind, id, seq, body): what each request (facilityId, push, cursor) pulls after its own push.

    Versions are dealt into blocks of sequence numbers.  A request only meets the blocks that have something for it, from its cursor to where its page is
    full; they are counted first, so that a block's rows know their places and are never sorted together."""
    shown = _shown(changes, state, counters)

    def take(pairs: pa.Table, versions: pa.Table) -> pa.Table:
        versions, alive = _alive(pairs, versions)
        before = pairs.column("before").to_numpy()
        own = [x[: max(page - b, 0)] for x, b in zip(alive, before, strict=True)]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        which = np.concatenate([np.empty(0, np.int64), *own])
        place = np.repeat(before, sizes) + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        asks, rows = pairs.select(["facilityId", "push"]).take(pa.array(np.repeat(np.arange(len(own)), sizes))), versions.select(["kind", "id", "seq", "body"]).take(pa.array(which))
        return pa.table({"facilityId": asks.column(0), "push": asks.column(1), "place": pa.array(place.astype(np.int32)), **{c: rows.column(c) for c in rows.column_names}})

    return _meet(_reached(requests, shown, page), shown, ["kind", "id", "body"], take, "facilityId string, push long, place int, kind string, id string, seq long, body string")


def responses(requests: DataFrame, changes: DataFrame, state: DataFrame | None = None, counters: DataFrame | None = None, page: int = PAGE_SIZE) -> DataFrame:
    """(facilityId, push, pushed, conflicts, records, cursor, hasMore): the answer to each request (facilityId, push, cursor).

    Every one is answered as of its own push, as if requests had come one by one; one without records pulls only.  The
    refused records are in `conflicts`, what is sent in `pages`, of which only the last row is looked up here."""
    shown = _shown(changes, state, counters)
    told = judged(changes, state).groupBy("facilityId", "push").agg(F.count_if("accepted").alias("pushed"), F.count_if(~F.col("accepted")).alias("conflicts"))

    def last(pairs: pa.Table, versions: pa.Table) -> pa.Table:
        versions, alive = _alive(pairs, versions)
        seq, before = versions.column("seq").to_numpy(), pairs.column("before").to_numpy()
        own = [x[: max(page - b, 0)] for x, b in zip(alive, before, strict=True)]
        records = before + np.fromiter(map(len, own), np.int64, len(own))
        latest = np.fromiter((seq[x[-1]] if len(x) else -1 for x in own), np.int64, len(own))
        return pa.table({"facilityId": pairs.column("facilityId"), "push": pairs.column("push"), "records": pa.array(records), "latest": pa.array(latest)}).filter(pa.array(latest >= 0))

    sent = _meet(_reached(requests, shown, page, last=True), shown, [], last, "facilityId string, push long, records long, latest long")
    out = requests.join(told, ["facilityId", "push"], "left").join(sent, ["facilityId", "push"], "left")
    none = F.lit(0).cast("long")
    return out.select("facilityId", "push", F.coalesce("pushed", none).alias("pushed"), F.coalesce("conflicts", none).alias("conflicts"), F.coalesce("records", none).alias("records"), F.coalesce("latest", "cursor").alias("cursor"), (F.coalesce("records", none) == page).alias("hasMore"))


# --- the client's side ----------------------------------------------------------------------------------------------


def client_decisions(local: DataFrame, remote: DataFrame, protect_drafts: bool) -> DataFrame:
    """(id, outcome) for pulled records: skipped, refused or pulled.

    A local copy that is as new is skipped, even if it is a draft; an older local draft refuses."""
    columns = ["id", F.col("updatedAt").alias("localUpdatedAt")] + ([F.col("status").alias("localStatus")] if protect_drafts else [])
    both = remote.join(local.select(*columns), "id", "left")
    out = F.when(F.col("localUpdatedAt") >= F.col("updatedAt"), "skipped")
    if protect_drafts:
        out = out.when(F.col("localStatus") == "draft", "refused")
    return both.select("id", out.otherwise("pulled").alias("outcome"))


def client_apply(local: DataFrame, remote: DataFrame, now_ms: int, protect_drafts: bool) -> DataFrame:
    """The local table after a pull; accepted rows are replaced whole and acknowledged at `now_ms`."""
    taken = client_decisions(local, remote, protect_drafts).filter("outcome = 'pulled'").select("id")
    new = remote.join(taken, "id", "left_semi").withColumn("syncedAt", F.lit(now_ms)).select(local.columns)
    return local.join(taken, "id", "left_anti").select(local.columns).unionByName(new)


def acknowledge(local: DataFrame, pushed: DataFrame, at_ms: int) -> DataFrame:
    """Mark pushed records as known to the server, unless they changed since."""
    sent = pushed.select(F.col("id").alias("sentId"), F.col("updatedAt").alias("sentAt")).distinct()
    both = local.join(sent, (F.col("id") == F.col("sentId")) & (F.col("updatedAt") == F.col("sentAt")), "left")
    return both.withColumn("syncedAt", F.when(F.col("sentAt").isNotNull(), F.lit(at_ms)).otherwise(F.col("syncedAt"))).select(local.columns)


def outcome(conflict_rows: DataFrame, pushed: DataFrame, decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """(ok, error, pushed, pulled, conflicts, refused, cursor) of a round, one row; `pushed` are the records that the
    server accepted."""
    one = pushed.agg(F.count("*").alias("pushed")).crossJoin(decisions.agg(F.count_if(F.col("outcome") == "pulled").alias("pulled"), F.count_if(F.col("outcome") == "refused").alias("refused")))
    one = one.crossJoin(conflict_rows.agg(F.count("*").alias("conflicts"))).crossJoin(facts.select("cursor"))  # one row each
    return one.select(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), "pushed", "pulled", "conflicts", "refused", "cursor")


#: Ways in which a round fails without changing anything: settings are missing, no answer in time, no connection; and `http_` with a status.
ERRORS = ("not_configured", "timeout", "network")


def failed(spark: SparkSession, error: str, cursor: int) -> DataFrame:
    """The outcome of a round that failed."""
    if error not in ERRORS and not error.startswith("http_"):
        raise ValueError(error)
    return spark.createDataFrame([(False, error, 0, 0, 0, 0, cursor)], "ok boolean, error string, pushed long, pulled long, conflicts long, refused long, cursor long")


@dataclass(frozen=True)
class Round:
    """What a round leaves: the outcome, both local tables, and the server's store and counters."""

    outcome: DataFrame
    patients: DataFrame
    encounters: DataFrame
    state: DataFrame
    counters: DataFrame


def sync_round(patients: DataFrame, encounters: DataFrame, state: DataFrame, counters: DataFrame, facility: str, cursor: int, push: int, now_ms: int, page: int = PAGE_SIZE) -> Round:
    """A device's round: push what the server doesn't have, then pull the next page, the device's own records included.

    Pushed records are acknowledged even where the server had newer ones; what it has comes back with the page."""
    sent = {"patient": dirty(patients, False), "encounter": dirty(encounters, True)}
    rows = [df.select(F.lit(facility).alias("facilityId"), F.lit(push).cast("long").alias("push"), F.col("id").alias("ord"), F.lit(kind).alias("kind"), "id", F.col("updatedAt").cast("double").alias("updatedAt"), "deletedAt", F.to_json(F.struct("*")).alias("body")) for kind, df in sent.items()]
    changes = rows[0].unionByName(rows[1])
    refused, accepted = conflicts(changes, state), sequenced(changes, state, counters, wide=True)
    after = _stored(accepted, state)
    got = pull(after, facility, cursor, page)
    local, decided = {}, None
    for kind, table in (("patient", patients), ("encounter", encounters)):
        remote = got.filter(F.col("kind") == kind).select(F.from_json("body", table.schema).alias("r")).select("r.*")
        known = acknowledge(table, sent[kind], now_ms)
        own = client_decisions(known, remote, kind == "encounter")
        decided = own if decided is None else decided.unionByName(own)
        local[kind] = client_apply(known, remote, now_ms, kind == "encounter")
    return Round(outcome(refused, accepted, decided, page_facts(got, cursor, page)), local["patient"], local["encounter"], after, counters_after(changes, counters))
