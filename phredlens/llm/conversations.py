"""Conversation structure repair over a table of turns, whatever the length of a conversation.

Turns are range-partitioned and sorted by conversation and turn. A conversation that lies inside a partition and is of
usual length is repaired where it is. The others (at a partition's edge, or long) are cut into chunks: costs across a
chunk compose like matrices, so small streams over chunks give every chunk the costs after it and the state before it,
and then all chunks are repaired side by side.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from phredlens.llm import turn_grammar as grammar
from phredlens.llm.tables import begin, stage, unstage

#: Turns of a chunk, and bytes of text of a conversation that is repaired in one piece.
CHUNK, WHOLE_BYTES = 4096, 8 << 20
#: Characters of a text that order turns of the same number and role; beyond, its hash does.
ORDERED_BY = 256
_BLANKS = " \t\n\x0b\x0c\r"
_STATS = ["blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "first_turn", "last_turn", "n_turns"]
_PIECE = "audit string, turns array<struct<role:string,text:string>>, cost long, " + ", ".join(f"{c} long" for c in _STATS)
_RAW = "seq long, turn long, role string, text string, gone boolean, digest binary, again boolean"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as the checksum of ``conv_id:turn`` damages them, with gone: whether
    the row is dropped. A null counts as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("copy"))
    return rows.drop("copy")


def _faults(turns: list[tuple], again: list[bool]) -> tuple[bytes, list[int]]:
    """(codes, counts as in _STATS) of turns (turn, role, text) in order; ``again``: seen earlier."""
    codes, counts, roles = bytearray(), [0, 0, 0, 0], []
    for (_, role, text), seen in zip(turns, again, strict=True):
        bare = text.rstrip(_BLANKS)
        fault = grammar.UNWANTED if not bare or seen else grammar.OK if bare[-1] in ".!?" else grammar.TRUNCATED
        if fault:
            counts[0 if not bare else 1 if seen else 2] += 1
        c = grammar.code(role, fault)
        if roles and not grammar.legal(roles[-1], c // 3):
            counts[3] += 1
        roles.append(c // 3)
        codes.append(c)
    numbers = [t for t, _, _ in turns if t is not None]
    return bytes(codes), [*counts, *((roles[0], roles[-1]) if roles else (None, None)), *((numbers[0], numbers[-1]) if numbers else (None, None)), len(set(numbers))]


def _piece(turns: list[tuple], again: list[bool]) -> tuple:
    """The columns of _PIECE of a conversation that is all here."""
    codes, stats = _faults(turns, again)
    edits, state = grammar.walk(codes)
    edits.append(grammar.LAST_EDITS[state])
    out = grammar.rebuilt([t[1:] for t in turns], edits, grammar.START)
    return ("".join(edits), [{"role": r, "text": t} for r, t in out], grammar.costs_before(codes)[grammar.START], *stats)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _sorted_turns(rows: DataFrame) -> DataFrame:
    """Ranges of (conversation, turn, role, text). Equal turns are dealt out by a number of their own, so neither a
    conversation nor a repeated turn is one range; long texts don't reach the driver, which samples the ranges."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, ORDERED_BY), F.xxhash64("text")]
    return rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)


def _walked(rows: DataFrame, chunk: int, id_type: str) -> DataFrame:
    """Pieces of whole conversations (whole), and raw turns of the others with part, chunk and seq, their place."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    ddl = f"conv_id {id_type}, part int, chunk long, whole boolean, {_PIECE}, {_RAW}"
    schema = _arrow(ddl)
    n_piece, n_raw = len(_PIECE.split(", ")), len(_RAW.split(", "))

    def run(batches):
        begin()
        part, number, seq, first = TaskContext.get().partitionId(), 0, 0, True
        conv, held, size, seen, long = None, [], 0, set(), False
        out: list[tuple] = []

        def raw():
            nonlocal number, seq
            for k, (turn, role, text, gone, digest, again) in enumerate(held):
                if k % chunk == 0:
                    number += 1
                out.append((conv, part, number, False, *[None] * n_piece, seq, turn, role, text, gone, digest, again))
                seq += 1
            held.clear()

        def close():
            """A conversation ends that isn't the partition's last."""
            nonlocal first
            if first or long:
                raw()
            else:
                turns = [x for x in held if not x[3]]
                out.append((conv, part, None, True, *_piece([x[:3] for x in turns], [x[5] for x in turns]), *[None] * n_raw))
                held.clear()
            first = False

        started = False
        for b in batches:
            for i, turn, role, text, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not started or i != conv:
                    if started:
                        close()
                    started, conv, size, seen, long = True, i, 0, set(), False
                digest = hashlib.blake2b(f"{i is None} {i}\0{len(role)}\0{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                held.append((turn, role, text, gone, digest, not gone and digest in seen))
                if not gone:
                    seen.add(digest)
                size += len(text)
                if len(held) >= chunk or size > WHOLE_BYTES:
                    long, size = True, 0
                    raw()
                if len(out) >= 2000:
                    yield _batch(out, schema)
                    out = []
        if started:
            raw()
        yield _batch(out, schema)

    return _sorted_turns(rows.select("conv_id", "turn", "role", "text", "gone")).mapInArrow(run, ddl)


def _by_conversation(rows: DataFrame, falling: bool = False) -> DataFrame:
    """Chunks of a conversation in one partition, in order; a chunk is one short row here."""
    way = (lambda c: F.col(c).desc()) if falling else F.col
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), way("part"), way("chunk"))


def _streamed(rows: DataFrame, ddl: str, start, each) -> DataFrame:
    """``each(state, row)`` gives (state, output rows) along the chunks of a conversation, from ``start()`` on; a last call
    with no row ends the conversation. One row is held at a time."""
    schema = _arrow(ddl)
    at = rows.columns.index("conv_id")

    def run(batches):
        state, conv, started = None, None, False
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not started or row[at] != conv:
                    if started:
                        out += each(state, None)[1]
                    started, conv, state = True, row[at], start()
                state, more = each(state, row)
                out += more
            yield _batch(out, schema)
        yield _batch(each(state, None)[1] if started else [], schema)

    return rows.mapInArrow(run, ddl)


def _chunks(raw: DataFrame, id_type: str) -> DataFrame:
    """A row per chunk: its codes, the costs across it, and its counts."""
    ddl = f"conv_id {id_type}, part int, chunk long, codes binary, across array<long>, " + ", ".join(f"{c} long" for c in _STATS)
    schema = _arrow(ddl)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: r[3])
        turns = [r for r in rows if not r[7]]
        codes, stats = _faults([r[4:7] for r in turns], [r[8] for r in turns])
        return pa.Table.from_batches([_batch([(*rows[0][:3], codes, grammar.across(codes), *stats)], schema)])

    return raw.select("conv_id", "part", "chunk", "seq", "turn", "role", "text", "gone", "again").groupBy("part", "chunk").applyInArrow(run, ddl)


def _long_pieces(walked: DataFrame, id_type: str) -> DataFrame:
    """Pieces, one per chunk, of the conversations that aren't whole in ``walked``."""
    raw = walked.where("not whole").select("conv_id", "part", "chunk", *(c.split()[0] for c in _RAW.split(", ")))
    # A turn that is the first of its kind in a partition may have an earlier one in a partition before; such a kind has
    # a row per partition at most.
    firsts = raw.where("not gone and not again").select("part", "seq", "digest")
    home = firsts.groupBy("digest").agg(F.min("part").alias("home"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = firsts.join(home, "digest").where("part > home").select("part", "seq", F.lit(True).alias("later"))
    raw = stage(raw.join(later, ["part", "seq"], "left").withColumn("again", F.col("again") | F.coalesce("later", F.lit(False))).drop("later"))
    chunks = stage(_chunks(raw, id_type))
    at = f"conv_id {id_type}, part int, chunk long"

    def backward(after, row):
        if row is None:
            return after, []
        conv, part, chunk, across = row
        last = after is None
        after = grammar.END if last else after
        before = tuple(min(across[4 * p + q] + after[q] for q in range(4)) for p in range(4))
        return before, [(conv, part, chunk, list(after), before[grammar.START], last)]

    costs = stage(_streamed(_by_conversation(chunks.select("conv_id", "part", "chunk", "across"), falling=True), f"{at}, after array<long>, cost long, last boolean", lambda: None, backward))

    exit_schema = _arrow(f"{at}, exits array<int>")

    def exits(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield _batch([(*key, [grammar.walk(codes, q, tuple(after))[1] for q in range(4)]) for *key, codes, after in rows], exit_schema)

    def forward(state, row):
        return (state, []) if row is None else (row[3][state], [(*row[:3], state)])

    known = chunks.join(costs.drop("conv_id"), ["part", "chunk"]).select("conv_id", "part", "chunk", "codes", "after")
    entries = stage(_streamed(_by_conversation(known.mapInArrow(exits, f"{at}, exits array<int>")), f"{at}, entry int", lambda: grammar.START, forward))
    told = chunks.join(costs.drop("conv_id"), ["part", "chunk"]).join(entries.drop("conv_id"), ["part", "chunk"])
    told = told.select("part", "chunk", "conv_id", "codes", "after", "cost", "last", "entry", *_STATS)
    ddl = f"conv_id {id_type}, part int, chunk long, whole boolean, {_PIECE}"
    schema = _arrow(ddl)

    def mended(turns: pa.Table, info: pa.Table) -> pa.Table:
        row = info.to_pylist()[0]
        edits, state = grammar.walk(row["codes"], row["entry"], tuple(row["after"]))
        if row["last"]:
            edits.append(grammar.LAST_EDITS[state])
        rows = sorted(zip(*(turns.column(c).to_pylist() for c in ("seq", "role", "text", "gone")), strict=True), key=lambda r: r[0])
        out = grammar.rebuilt([r[1:3] for r in rows if not r[3]], edits, row["entry"])
        piece = (row["conv_id"], row["part"], row["chunk"], False, "".join(edits), [{"role": r, "text": t} for r, t in out], row["cost"], *(row[c] for c in _STATS))
        return pa.Table.from_batches([_batch([piece], schema)])

    both = raw.select("part", "chunk", "seq", "role", "text", "gone").groupBy("part", "chunk").cogroup(told.groupBy("part", "chunk"))
    out = stage(both.applyInArrow(mended, ddl))
    unstage(raw, chunks, costs, entries)
    return out


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pieces of repaired conversations: conv_id, part and chunk (the order of pieces), whole, audit, turns (role and text
    of each turn that is left, in order), cost (of this and the pieces after it), and counts of faults.

    ``rows`` are turns (conv_id, turn, role, text), and gone if some count only for their conv_id; a null role or text is
    one space. Turns stand in the order of their numbers, null ones first; those of one number by role, then by text (its
    first 256 characters, then its hash). Rows that repeat are turns of their own. Every conv_id, null too, has a piece;
    a conversation of up to ``chunk`` turns has one, but for those that two partitions share. An empty table gives no
    rows; other columns are ignored.

    Edits are deleting a turn (D), inserting one (I), keeping one (K), giving one another role (R); a turn that is blank or
    repeats an earlier one of the conversation is deleted. Of the cheapest edits the ASCII-least are taken.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone: Column = F.col("gone") if "gone" in rows.columns else F.lit(False)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), gone.alias("gone"))
    id_type = plain.dtypes[0][1]
    walked = stage(_walked(plain, chunk, id_type))
    columns = ["conv_id", "part", "chunk", "whole", *(c.split()[0] for c in _PIECE.replace("struct<role:string,text:string>", "x").split(", "))]
    return walked.where("whole").select(*columns).unionByName(_long_pieces(walked, id_type).select(*columns))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, nth, role, text): a row per turn that is left; the order is (part, chunk, nth)."""
    return pieces.select("conv_id", "part", "chunk", F.posexplode("turns").alias("nth", "t")).select("conv_id", "part", "chunk", "nth", "t.role", "t.text")


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def reports(pieces: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: numbers that are missing between the first and the last turn before the repair; illegal: neighbours before the
    repair whose roles may not follow one another; repaired_sha256: of ``role:text`` of the repaired turns, joined by line
    breaks. A conversation of several pieces is read in order, a piece at a time, because a digest goes along its text.
    """
    id_type = dict(pieces.dtypes)["conv_id"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.when(F.col("n_turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).otherwise(F.lit(0).cast("long"))
    one = pieces.where("whole").select("conv_id", gaps.alias("gaps"), *_REPORT[1:], "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    some = pieces.where("not whole").select("conv_id", "part", "chunk", "audit", lines.alias("lines"), "cost", *_STATS)

    def start():
        return {"sha": hashlib.sha256(), "any": False, "audit": [], "n": dict.fromkeys(_REPORT, 0), "role": None, "first": None, "last": None, "turns": 0, "conv": None, "cost": None}

    def each(s, row):
        if row is None:
            s["n"]["gaps"] = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
            s["n"]["cost"] = s["cost"]
            return s, [(s["conv"], *(s["n"][c] for c in _REPORT), "".join(s["audit"]), s["sha"].hexdigest())]
        conv, _, _, audit, text, cost, blank, duplicate, truncated, illegal, first_role, last_role, first_turn, last_turn, n_turns = row
        s["conv"] = conv
        if s["cost"] is None:
            s["cost"] = cost
        s["audit"].append(audit)
        if text:
            s["sha"].update(("\n" if s["any"] else "").encode() + text.encode("utf-8", "surrogatepass"))
            s["any"] = True
        for c, v in zip(_REPORT[1:5], (blank, duplicate, truncated, illegal), strict=True):
            s["n"][c] += v
        if first_role is not None:
            s["n"]["illegal"] += s["role"] is not None and not grammar.legal(s["role"], first_role)
            s["role"] = last_role
        if n_turns:
            s["turns"] += n_turns - (s["last"] == first_turn)
            s["first"] = first_turn if s["first"] is None else s["first"]
            s["last"] = last_turn
        return s, []

    long = _streamed(_by_conversation(some), f"conv_id {id_type}, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string", start, each)
    return one.unionByName(long)
