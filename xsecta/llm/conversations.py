"""Conversation structure repair: rows, edits and a role grammar as weighted automata, composed and searched by shortest path."""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Edits and their costs; a truncated row that stays costs TRUNCATED more. An edit's initial is its label.
COSTS, TRUNCATED = {"K": 0, "R": 2, "D": 3, "I": 2}, 1
#: The role grammar (s?(ua)+)? by initials: its states are the start and the last initial; transitions and ends.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
MADE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Faults of a row, the first one that holds; those above the others must be deleted.
FINE, CUT, DUPLICATE, BLANK = range(4)
SOLID = r"[^\x20\x09-\x0D]"
#: Rows whose product is taken one by one before products are multiplied pairwise.
SEGMENT = 64

# A weight is (cost, labels) or None; the lesser one is that of the lesser cost, then of the least labels. A matrix holds
# the least weight between each two states of the grammar.


def _times(a, b):
    """The product of two matrices: the least weight of all ways through a state between."""
    out = []
    for row in a:
        ways = [(k, w) for k, w in enumerate(row) if w is not None]
        out.append([min(((w[0] + b[k][j][0], w[1] + b[k][j][1]) for k, w in ways if b[k][j] is not None), default=None) for j in range(4)])
    return out


@cache
def _inserts():
    """Inserting any number of rows: user and assistant only, each way once."""
    found = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
    for p in range(4):
        q, n = p, 0
        while True:
            q, n = next(NEXT[q, r] for r in MADE if (q, r) in NEXT), n + 1
            if found[p][q] is not None:
                break
            found[p][q] = (COSTS["I"] * n, "I" * n)
    return found


@cache
def _edit(initial: str, fault: int):
    """Inserting before a row of that role initial and fault, then one edit of it."""
    kept = TRUNCATED if fault == CUT else 0
    arcs = [[[] for _ in range(4)] for _ in range(4)]
    for p in range(4):
        arcs[p][p].append((COSTS["D"], "D"))
        for r in [] if fault >= DUPLICATE else {initial, *MADE}:
            if (p, r) in NEXT:
                arcs[p][NEXT[p, r]].append((COSTS["K"] + kept, "K") if r == initial else (COSTS["R"] + kept, "R"))
    return _times(_inserts(), [[min(ways, default=None) for ways in row] for row in arcs])


def product(matrices: list):
    """The product in order, neighbours pairwise, so labels are copied as often as the logarithm of their number says."""
    while len(matrices) > 1:
        pairs = [_times(*matrices[i : i + 2]) for i in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[2 * len(pairs) :]
    return matrices[0]


def rows_matrix(rows: list[tuple[str, int]]):
    """The matrix of rows (initial, fault) in order."""
    parts = []
    for i in range(0, len(rows), SEGMENT):
        m = _edit(*rows[i])
        for row in rows[i + 1 : i + SEGMENT]:
            m = _times(m, _edit(*row))
        parts.append(m)
    return product(parts)


def cheapest(matrix) -> tuple[int, str]:
    """Cost and labels of the best way through all rows to an end of the grammar."""
    return min(w for w in (_times(matrix, _inserts())[START][q] for q in ENDS) if w is not None)


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) damaged by crc32('conv_id:turn') % 20, nulls as one space.

    0 drops the row, 1 empties its text, 2 removes the text's sentence marks, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(harm == 4, "user").otherwise(blank("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1)))
    return rows.filter(harm != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows with a number (uid), a digest of the text (mark) and the first fault of each row."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = blank("text")
    marked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), text.alias("text"), F.sha2(text, 256).alias("mark"))
    marked = saved(marked.withColumn("uid", F.monotonically_increasing_id()))
    # the first of equal rows by an aggregate, so repeated rows of any number are no hot group
    first = marked.groupBy("conv_id", "role", "mark").agg(F.min(F.struct("turn", "uid")).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("new"))
    fault = (
        F.when(~F.col("text").rlike(SOLID), BLANK).when(F.col("new").isNull(), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(FINE)
    )
    return saved(marked.join(first, "uid", "left").select("conv_id", "turn", "role", "text", "mark", "uid", fault.alias("fault")))


FRAGMENTS = "part int, first string, last string, illegal long, blank long, duplicate long, truncated long, costs array<long>, labels array<string>"


def _fragments(names: list[str]):
    """One row for each conversation of a sorted partition: its counts and its matrix."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, roles, held = [], [], []

        def row(roles, held):
            flat = [w for line in rows_matrix(list(zip(roles, held))) for w in line]
            illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
            counts = [sum(f == kind for f in held) for kind in (BLANK, DUPLICATE, CUT)]
            return [part, roles[0], roles[-1], illegal, *counts, [None if w is None else w[0] for w in flat], [None if w is None else w[1] for w in flat]]

        def table(done):
            out = [pa.array([i for i, _ in done], kind)]
            kinds = (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays(out + [pa.array([r[k] for _, r in done], t) for k, t in enumerate(kinds)], names)

        kind, now = None, object()
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for i, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault"))):
                if i != now and roles:
                    done.append((now, row(roles, held)))
                    roles, held = [], []
                now = i
                roles.append(initial), held.append(fault)
            if done:
                yield table(done)
        if roles:
            yield table([(now, row(roles, held))])

    return run


def _joined(names: list[str]):
    """Counts, cost and audit of each conversation from its fragments in order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                cells = lambda p: [[None if c is None else (c, x) for c, x in zip(p["costs"][i : i + 4], p["labels"][i : i + 4])] for i in range(0, 16, 4)]
                cost, audit = cheapest(product([cells(p) for p in parts]))
                between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
                out.append([*(sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")), sum(p["illegal"] for p in parts) + between, cost, audit])
            kinds = [*[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names)

    return run


def audits(found: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost and audit of each conversation of faults().

    The rows' automaton, the edit transducer and the role grammar are never built: the composition of a single row with both
    is a 4 x 4 matrix over the grammar's states, made when such a row comes. Products of these matrices over the lexicographic
    (cost, labels) weights are associative, so rows are sorted into ranges whatever conversation they are of; each range
    multiplies its fragments, and only these products meet by conversation: a long one is shared by many tasks.
    """
    kind = found.schema["conv_id"].dataType.simpleString()
    light = found.select("conv_id", "turn", "role", "mark", "uid", F.substring("role", 1, 1).alias("initial"), "fault")
    order = ["conv_id", "turn", "role", "mark", "uid"]
    shape = f"conv_id {kind}, {FRAGMENTS}"
    names = ["conv_id", *[c.split()[0] for c in FRAGMENTS.split(", ")]]
    parts = light.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_fragments(names), shape)
    lists = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("parts"))
    out = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return saved(lists.mapInArrow(_joined(["conv_id", *[c.split()[0] for c in out.split(", ")]]), f"conv_id {kind}, {out}"))


def _applied(batches):
    """(conv_id, place, role, text) of repaired rows: each conversation's audit, then its rows in order, one by one."""
    import pyarrow as pa

    labels, state, place, now = iter(()), START, 0, None
    out = []

    def emit(role, text):
        nonlocal place, state
        state = NEXT[state, role[0]]
        place += 1
        out.append((now, place, role, text))

    def inserted():
        """Emit rows that are inserted here; the next label of another kind, or none at the end."""
        for label in labels:
            if label != "I":
                return label
            emit(made(), "")
        return None

    def made():
        return next(role for r, role in MADE.items() if (state, r) in NEXT)

    def table(kind):
        rows = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((kind, pa.int64(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text"])
        out.clear()
        return rows

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                inserted()
                labels, state, place, now = iter(audit), START, 0, i
            elif (label := inserted()) != "D":
                emit(role if label == "K" else made(), text)
        yield table(kind)
    if kind is not None:
        inserted()
        yield table(kind)


def repaired(found: DataFrame, audit: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the conversations of faults() after the edits of audits(); rows of a conversation
    stay together and in order. They stream through one task, which holds the audit and no texts."""
    kind = found.schema["conv_id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    heads = audit.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("mark"), none("long").alias("uid"), none("string").alias("text"), "audit")
    rows = found.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "mark", "uid", "text", none("string").alias("audit"))
    ordered = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark", "uid")
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(_applied, f"conv_id {kind}, place long, role string, text string")


def _digests(batches):
    """(conv_id, repaired_sha256) of rows that come conversation by conversation, in order."""
    import pyarrow as pa

    now, state, kind = None, None, None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for i, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if place == 1:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = i, hashlib.sha256()
            state.update((b"\n" if place > 1 else b"") + f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of rows(conv_id, turn, role, text), and for each other one of ids(conv_id).

    gaps counts turns that are missing between the first and last; blank, duplicate and truncated count rows by their first
    fault, illegal the neighbours whose role initials are not su, ua or au; cost and audit are those of the cheapest edits, and
    repaired_sha256 digests the repaired rows. Rows are taken by turn (nulls first), then role, then a digest of the text.

    A null role or text is one space; a null conv_id is a conversation of its own; repeated rows are duplicates. A conversation
    without rows, or one whose rows are all deleted, has an empty audit or one of D only, and the digest of an empty string.
    Texts of any length are whole; other columns are ignored; empty tables give no rows.
    """
    found = faults(rows)
    audit = audits(found)
    kind = found.schema["conv_id"].dataType.simpleString()
    digests = repaired(found, audit).mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")
    gaps = found.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    every = found.select("conv_id").distinct() if ids is None else ids.select("conv_id").distinct()
    parts = every.unionByName(gaps, True).unionByName(audit, True).unionByName(digests, True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op13_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damaged(rows), rows)


# the same automata as a table of steps: the best (cost, labels) of each state after each row
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY i) AS r FROM bits WHERE k = 8),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
harmed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda a, b: xor(a >> 8, r[xor(a & 255, b) + 1])), 4294967295) % 20 AS harm FROM keyed CROSS JOIN remainders),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
         unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM harmed WHERE harm <> 0),
numbered AS (
  SELECT *, substr(role, 1, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM rows_),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 3 WHEN again > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY 1),
inserts AS (SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) t(p, q, l)),
arcs AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(p, r, q)),
edits AS (
  SELECT j.conv_id, j.i, a.p, a.q, CASE WHEN j.r = a.r THEN 0 ELSE 2 END + CAST(fault = 1 AS INT) AS cost, CASE WHEN j.r = a.r THEN 'K' ELSE 'R' END AS l
  FROM judged j JOIN arcs a ON fault < 2 AND (j.r = a.r OR a.r <> 's')
  UNION ALL SELECT conv_id, i, p, p, 3, 'D' FROM judged CROSS JOIN range(4) t(p)),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, '000000000' AS best FROM counts
  UNION ALL
  SELECT s.conv_id, e.i, CAST(e.q AS BIGINT), min(printf('%09d', CAST(substr(best, 1, 9) AS INT) + 2 * length(n.l) + e.cost) || substr(best, 10) || n.l || e.l)
  FROM steps s JOIN inserts n ON n.p = s.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i + 1 AND e.p = n.q GROUP BY s.conv_id, e.i, e.q),
ended AS (
  SELECT c.conv_id, min(printf('%09d', CAST(substr(best, 1, 9) AS INT) + 2 * length(n.l)) || substr(best, 10) || n.l) AS best
  FROM counts c JOIN steps s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n JOIN inserts n ON n.p = s.q AND n.q IN (0, 3) GROUP BY 1),
labels AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS l, generate_subscripts(string_split(substr(best, 10), ''), 1) AS k FROM ended WHERE length(best) > 9),
placed AS (SELECT *, sum(CAST(l <> 'I' AS INT)) OVER (PARTITION BY conv_id ORDER BY k) AS i, sum(CAST(l <> 'D' AS INT)) OVER (PARTITION BY conv_id ORDER BY k) AS place FROM labels),
kept AS (
  SELECT p.conv_id, p.place, p.l, j.role, j.text, j.r, first_value(p.l = 'K' AND j.r = 's') OVER (PARTITION BY p.conv_id ORDER BY p.place) AS led
  FROM placed p LEFT JOIN judged j ON p.l <> 'I' AND j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i WHERE p.l <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (place - CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS t FROM kept GROUP BY 1)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(substr(e.best, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(e.best, 10), '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
