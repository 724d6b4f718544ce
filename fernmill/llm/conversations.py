"""Conversation repair by shortest paths over small integer costs.

A conversation is legal if its role initials read ``(s?(ua)+)?``: an optional
system turn, then user and assistant in turns. An edit script goes over its rows
in order. A node of the graph is a place between rows and a state of that grammar;
its arcs are the edits Keep (0), Rerole to user or assistant (2), Delete (3) and
Insert of an empty turn (2); rows that stay although their text breaks off cost 1
more. Blank and repeated rows must go.

Dial's algorithm, run from the end, gives each node's distance: costs are small
integers, so a ring of buckets serves as the queue. Walking from the start along
tight arcs, the least letter first, gives the cheapest script that is least in
ASCII; from a node each letter leads to one place, so letters name the script.

Rows are ordered once, as skeletons without texts, and cut into blocks of at most
``BLOCK``. A conversation in one block is settled there. For the others, blocks
give the costs from each state to each state, a pass over those alone carries the
distances back and the entered states forth, and the blocks are walked then. So
no task holds a long conversation's rows; only digests read its texts in order,
as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmill.llm.scratch import written

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Rows of a block, as a power of two.
BLOCK_BITS = 9
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

# Classes of role initials, faults of rows, states of the grammar.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NAMES = ("system", "user", "assistant")
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: The state after a class in a state, -1 if illegal; the class that may be inserted in a state.
NEXT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
FITS = (USER, USER, ASSISTANT, USER)
AFTER = tuple(NEXT[s][FITS[s]] for s in range(4))
#: Cost from each state to the end, by inserts alone.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def distances(codes: list[int], ahead: list[int], last: bool) -> list[int]:
    """Cost from each node, 4 * place + state, to the end, where states cost ``ahead``; ``FAR`` if there is no way.

    A code is 4 * class + fault. Turns may be inserted before each row, and after the last one of the conversation.
    """
    n = len(codes)
    dist = [FAR] * (4 * n + 4)
    known = [x for x in ahead if x < FAR]
    base = min(known)
    width = max(max(known) - base, REROLE + CUT_OFF, DELETE) + 1
    ring: list[list[int]] = [[] for _ in range(width)]
    for s, x in enumerate(ahead):
        if x < FAR:
            dist[4 * n + s] = x - base
            ring[x - base].append(4 * n + s)
    waiting, d = len(known), 0
    while waiting:
        bucket = ring[d % width]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != d:
                continue
            i, t = node >> 2, node & 3
            arcs: list[tuple[int, int]] = []
            if i < n or last:
                arcs += [(4 * i + s, INSERT) for s in range(4) if AFTER[s] == t]
            if i:
                cls, fault = codes[i - 1] >> 2, codes[i - 1] & 3
                at = 4 * i - 4
                arcs.append((at + t, DELETE))
                if fault <= TRUNCATED:
                    for s in range(4):
                        if NEXT[s][cls] == t:
                            arcs.append((at + s, KEEP + fault * CUT_OFF))
                        elif AFTER[s] == t:
                            arcs.append((at + s, REROLE + fault * CUT_OFF))
            for other, cost in arcs:
                if d + cost < dist[other]:
                    dist[other] = d + cost
                    ring[(d + cost) % width].append(other)
                    waiting += 1
        d += 1
    return [x + base if x < FAR else FAR for x in dist]


def walk(codes: list[int], dist: list[int], entry: int, last: bool) -> tuple[list[str], int]:
    """An edit for each row, of the cheapest script least in ASCII, and the state at the end.

    An edit has u or a for each turn inserted before the row, then D, K, U or A
    (rerole to user, assistant); the last row's may go on with turns after it.
    """
    edits, now, i, s = [], "", 0, entry
    while i < len(codes):
        d, cls, fault = dist[4 * i + s], codes[i] >> 2, codes[i] & 3
        rest = dist[4 * i + 4 : 4 * i + 8]
        if rest[s] + DELETE == d:
            edits.append(now + "D")
        elif dist[4 * i + AFTER[s]] + INSERT == d:
            now, s = now + "sua"[FITS[s]], AFTER[s]
            continue
        elif fault <= TRUNCATED and NEXT[s][cls] >= 0 and rest[NEXT[s][cls]] + KEEP + fault * CUT_OFF == d:
            edits.append(now + "K")
            s = NEXT[s][cls]
        else:
            edits.append(now + "SUA"[FITS[s]])
            s = AFTER[s]
        now, i = "", i + 1
    while last and s in (AFTER_SYSTEM, AFTER_USER):
        edits[-1] += "sua"[FITS[s]]
        s = AFTER[s]
    return edits, s


_LETTERS = str.maketrans("uaUA", "IIRR")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from state to state of each block."""
    units = [[0 if s == q else FAR for s in range(4)] for q in range(4)]
    for batch in batches:
        found = []
        for codes in batch.column("codes").to_pylist():
            to = [distances(codes, u, False)[:4] for u in units]
            found.append([to[q][p] for p in range(4) for q in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("blk"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "blk", "costs"])


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies ahead of each block, its conversation's blocks coming last first."""
    seen, ahead = False, list(END)
    conv = None
    for batch in batches:
        out = []
        for own, costs in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            if not seen or own != conv:
                seen, conv, ahead = True, own, list(END)
            out.append(ahead)
            ahead = [min(min(costs[4 * p + q] + ahead[q] for q in range(4)), FAR) for p in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("blk"), pa.array(out, pa.list_(pa.int64()))], names=["conv", "blk", "ahead"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block is left for each state it may be entered in."""
    for batch in batches:
        out = []
        for codes, ahead in zip(batch.column("codes").to_pylist(), batch.column("ahead").to_pylist(), strict=True):
            dist = distances(codes, ahead, False)
            out.append([walk(codes, dist, s, False)[1] if dist[s] < FAR else -1 for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("blk"), batch.column("ahead"), pa.array(out, pa.list_(pa.int32())), batch.column("first"), batch.column("final")], names=["conv", "blk", "ahead", "exits", "first", "final"])


def _forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block is entered and the class before it, its conversation's blocks coming in order."""
    seen, conv, state, before = False, None, START, -1
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("conv", "exits", "final"))
        for own, exits, final in zip(*columns, strict=True):
            if not seen or own != conv:
                seen, conv, state, before = True, own, START, -1
            out.append((state, before))
            state, before = exits[state], final
        entry, before_ = (pa.array([x[k] for x in out], pa.int32()) for k in range(2))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("blk"), batch.column("ahead"), entry, before_], names=["conv", "blk", "ahead", "entry", "before"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and faults of each block, and its rows' edits."""
    names = ["conv", "blk", "seqs", "edits", "audit", "cost", "blank", "duplicate", "truncated", "illegal"]
    kinds = [pa.list_(pa.string()), pa.string(), *[pa.int64()] * 5]
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("codes", "counts", "ahead", "entry", "before", "last"))
        for codes, counts, ahead, entry, before, last in zip(*columns, strict=True):
            dist = distances(codes, ahead, last)
            edits, state = walk(codes, dist, entry, last)
            faults, illegal, cost = [0] * 4, 0, dist[entry] - (0 if last else ahead[state])
            letters = []
            for code, n, edit in zip(codes, counts, edits, strict=True):
                cls, fault = code >> 2, code & 3
                faults[fault] += 1
                faults[fault if fault >= BLANK else DUPLICATE] += n - 1
                illegal += n - 1 + (before >= 0 and (before, cls) not in LEGAL)
                before, cost = cls, cost + DELETE * (n - 1)
                own = len(edit) - len(edit.lstrip("ua")) + 1
                letters.append(edit[:own].translate(_LETTERS) + "D" * (n - 1) + edit[own:].translate(_LETTERS))
            out.append((edits, "".join(letters), cost, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal))
        made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("blk"), batch.column("seqs"), *made], names=names)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows in order, from each row's edit followed by its text and copies of it."""
    edit, seq = "", -1
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("conv", "role", "seq", "edit", "text"))
        for conv, role, own, what, text in zip(*columns, strict=True):
            if what is not None:
                edit, seq = what, own
                continue
            for k, letter in enumerate(edit):
                if letter in "ua":
                    out.append((conv, seq, k, NAMES[" ua".index(letter)], ""))
                elif letter != "D":
                    out.append((conv, seq, k, role if letter == "K" else NAMES[" UA".index(letter)], text))
            edit = ""
        if out:
            made = [pa.array([x[0] for x in out], batch.schema.field("conv").type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*made, *(pa.array([x[k] for x in out], pa.string()) for k in (3, 4))], names=["conv", "seq", "part", "role", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, its rows coming in order."""
    seen, conv, sha, kind = False, None, hashlib.sha256(), None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], names=["conv", "sha256"])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if seen and own == conv:
                sha.update(b"\n")
            else:
                if seen:
                    yield row()
                seen, conv, sha = True, own, hashlib.sha256()
            sha.update(f"{role}:{text}".encode())
    if seen:
        yield row()


@dataclass
class Repair:
    """What :func:`repair` found: a row for each conversation, and the repaired rows."""

    report: DataFrame
    messages: DataFrame

    def digests(self) -> DataFrame:
        """Rows (conv, sha256) of conversations with messages, over ``role:text`` joined by newlines.

        The digest is sequential by nature: a conversation's messages pass one
        task as a stream, of which it keeps the digest alone.
        """
        kind = self.messages.schema["conv"].dataType.simpleString()
        return self.messages.mapInArrow(_hashed, f"conv {kind}, sha256 string")


def _same(left: DataFrame, right: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """A join on columns that may be null, keeping the left side's."""
    named = right.select(*(F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns))
    match = F.lit(True)
    for c in on:
        match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(named, match, how).drop(*(f"_{c}" for c in on))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_bits: int = BLOCK_BITS) -> Repair:
    """Cheapest edits that make conversations legal.

    Rows of a conversation are taken by turn, nulls first, then by role and by
    the text's SHA-256; rows alike in all are one step with a count, all but the
    first of them duplicates. Roles and texts that are null count as one space; a
    null conversation is one like others, other columns are ignored. A row's
    first fault counts: blank (no word), duplicate (role and text seen before) or
    truncated (no ``.!?`` at the end). ``report`` has conv, gaps, blank,
    duplicate, truncated, illegal, cost and audit; ``messages`` (conv, seq, part,
    role, text), the repaired rows, whose partitions hold whole conversations in
    order. An empty table gives none of either.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    texts = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text")).withColumn("key", _key(F.col("text")))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(*ENDS), SOUND).otherwise(TRUNCATED)
    alike = ["conv", "turn", "role", "key"]
    steps = written(texts.select(*alike, fault.alias("fault")).groupBy(*alike).agg(F.max("fault").alias("fault"), F.count("*").alias("n")), "steps")
    steps = steps.repartitionByRange(*alike).sortWithinPartitions(*alike).withColumn("seq", F.monotonically_increasing_id())
    steps = written(steps, "ordered")

    # The first row of a role and text within a conversation; its number is a key that no two rows share.
    firsts = steps.groupBy("conv", "role", "key").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_first"))
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    coded = steps.join(firsts, "seq", "left").select("conv", "seq", (4 * cls + fault).cast("int").alias("code"), "n")
    packed = coded.groupBy("conv", F.shiftright("seq", block_bits).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("seq", "code", "n"))).alias("x"))
    blocks = written(packed.select("conv", "blk", F.col("x.seq").alias("seqs"), F.col("x.code").alias("codes"), F.col("x.n").alias("counts")), "blocks")

    kind = blocks.schema["conv"].dataType.simpleString()
    long = _same(blocks.select("conv", "blk", "codes"), blocks.groupBy("conv").agg(F.max("blk").alias("end"), F.count("*").alias("parts")).where("parts > 1"), "conv")
    long = written(long, "long")
    costs = long.mapInArrow(_matrices, f"conv {kind}, blk long, costs array<long>")
    ahead = costs.repartition("conv").sortWithinPartitions("conv", F.desc("blk")).mapInArrow(_back, f"conv {kind}, blk long, ahead array<long>")
    outer = (F.shiftright(F.get("codes", at), 2).alias(name) for at, name in ((F.lit(0), "first"), (F.size("codes") - 1, "final")))
    left = _same(long, written(ahead, "ahead"), "conv", "blk").select("conv", "blk", "codes", "ahead", *outer)
    exits = left.mapInArrow(_exits, f"conv {kind}, blk long, ahead array<long>, exits array<int>, first int, final int")
    chain = exits.repartition("conv").sortWithinPartitions("conv", "blk").mapInArrow(_forth, f"conv {kind}, blk long, ahead array<long>, entry int, before int")
    chain = _same(written(chain, "chain"), long.select("conv", "blk", "end"), "conv", "blk").withColumn("last", F.col("blk") == F.col("end")).drop("end")

    alone = {"ahead": F.array(*map(F.lit, END)).cast("array<long>"), "entry": F.lit(START), "before": F.lit(-1), "last": F.lit(True)}
    whole = _same(blocks, chain, "conv", "blk", how="left").select("conv", "blk", "seqs", "codes", "counts", *(F.coalesce(F.col(c), x).alias(c) for c, x in alone.items()))
    schema = f"conv {kind}, blk long, seqs array<long>, edits array<string>, audit string, cost long, blank long, duplicate long, truncated long, illegal long"
    settled = written(whole.mapInArrow(_settled, schema), "settled")

    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("blk", "audit"))), lambda x: x["audit"]), "").alias("audit")
    turns = steps.select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    report = _same(settled.groupBy("conv").agg(*sums, audit), turns, "conv", how="left").select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = settled.select(F.explode(F.arrays_zip("seqs", "edits")).alias("x")).select(F.col("x.seqs").alias("seq"), F.col("x.edits").alias("edit"))
    placed = steps.join(edits, "seq").select(*alike, "seq", "edit", F.lit(None).cast("string").alias("text"))
    both = placed.unionByName(texts.withColumns({"seq": F.lit(None).cast("long"), "edit": F.lit(None).cast("string")}))
    both = both.repartition("conv").sortWithinPartitions(*alike, F.col("edit").isNull()).select("conv", "role", "seq", "edit", "text")
    return Repair(report, both.mapInArrow(_repaired, f"conv {kind}, seq long, part int, role string, text string"))


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` rows, damaged by a hash of conversation and turn modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the
    row and 4 makes its role user. Nulls in role and text become a space, and
    stand as one in the hash.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("hurt") == 1, F.lit("")).when(F.col("hurt") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(F.col("hurt") == 4, F.lit("user")).otherwise(said("role"))
    out = rows.withColumn("hurt", hurt).where("hurt <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "hurt")
    return out.withColumn("copy", F.explode(F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("hurt", "copy")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows``: faults after damage, and the cheapest repair with its audit and digest."""
    found = repair(damage(rows))
    out = _same(rows.select(F.col("conv_id").alias("conv")).distinct(), found.report, "conv", how="left")
    out = _same(out, found.digests(), "conv", how="left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The query in DuckDB's SQL: best rest of the script for each state, found row by row from the end."""
    byte = "list_reduce([xor(c, x)] || range(8), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda q: ascii(q)::BIGINT), lambda c, x: {byte}), 4294967295)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    best = lambda cost, letter, said, rest: f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 'm': " + (f"{said} || CASE WHEN {rest}.m = '' THEN '' ELSE chr(10) || {rest}.m END" if said else f"{rest}.m") + "}"
    least = lambda *options: f"list_sort(list_filter([{', '.join(options)}], lambda z: z IS NOT NULL))[1]"
    options = []
    for s in range(4):
        keep = " ".join(f"WHEN cls = {c} THEN " + best("cut", "K", "role || ':' || text", f"b{NEXT[s][c]}") for c in range(3) if NEXT[s][c] >= 0)
        rerole = best("2 + cut", "R", f"'{NAMES[FITS[s]]}:' || text", f"b{AFTER[s]}")
        options.append(least(best("3", "D", "", f"b{s}"), f"CASE WHEN gone THEN NULL {keep} END", f"CASE WHEN NOT gone THEN {rerole} END") + f" AS o{s}")
    insert = lambda s, rest: best("2", "I", f"'{NAMES[FITS[s]]}:'", rest)
    return f"""
WITH RECURSIVE
hurt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hurt WHERE h <> 0),
placed AS (
  SELECT *, rtrim(text, {white}) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, role, sha256(text), copy) > 1 AS seen
  FROM damaged),
judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen AS duplicate, bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         bare = '' OR seen AS gone, left(role, 1) AS initial, CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS cls,
         CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before
  FROM placed),
walk AS (
  SELECT conv_id, max(i) + 1 AS i, {{'c': 0::BIGINT, 'a': '', 'm': ''}} AS b0, {{'c': 4::BIGINT, 'a': 'II', 'm': 'user:' || chr(10) || 'assistant:'}} AS b1,
         {{'c': 2::BIGINT, 'a': 'I', 'm': 'assistant:'}} AS b2, {{'c': 0::BIGINT, 'a': '', 'm': ''}} AS b3
  FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {least("o0", insert(0, "c2"))}, {least("o1", insert(1, "c2"))}, c2, {least("o3", insert(3, "o2"))}
  FROM (SELECT *, {least("o2", insert(2, "o3"))} AS c2
        FROM (SELECT w.conv_id, j.i, {", ".join(options)}
              FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i - 1) o) p),
done AS (SELECT conv_id, b0 FROM walk WHERE i = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate,
         sum(truncated::INT) AS truncated, sum((i > 1 AND before || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal
  FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b0.c, 0)::BIGINT AS cost,
       coalesce(b0.a, '') AS audit, sha256(coalesce(b0.m, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
"""


SQL = _sql()
