"""Conversation repair: the cheapest edits that give a conversation the role order ``(s?(ua)+)?``, by A* on the edit lattice.

A node of the lattice is (rows consumed, state of the role order); edges keep, rerole or delete the next row or insert one. The
heuristic is the suffix sum of what each row costs at least: a mandatory deletion, or the cheaper of deletion and the charge of a
truncated row. It is consistent, so nodes are settled in the order of (cost + heuristic, audit), and the first audit that reaches
a node is its cheapest, ties to the ASCII-least.

Rows are sorted by range over all conversations, so that a conversation of any size spreads over tasks. One that lies within a
task and has at most CHUNK rows is repaired there. The others are cut into chunks; each gets the cheapest edits from every state
to every state (they end in a consumed row, so no audit is a prefix of another), the chunks of a conversation are folded by these
alone, and the edits go back to the texts. What is hashed at the end is streamed.

Defined results: rows are taken by turn (nulls first), then role and text; null roles and texts are one space; a role counts by its
first character. Repeated rows are duplicates, as any other row whose role and text were seen before. A null conv_id is a
conversation of its own. Texts are judged whole. A conversation without rows has zeros, an empty audit and the hash of nothing; an
empty table gives an empty one. Columns beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import release, trimmed, written

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
CHUNK = 512
BLANKS = " \t\n\x0b\x0c\r"
#: State of the role order by the last role: nothing, system, user, assistant. What may be made next, and what kept roles lead to.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
FAULTS = ("blank", "duplicate", "truncated")
FINE = -1
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def fault(text: str, seen: bool) -> int:
    """Index of the row's first fault, or FINE."""
    t = text.strip(BLANKS)
    return 0 if not t else 1 if seen else 2 if t[-1] not in ".!?" else FINE


def cheapest(initials: list[str], faults: list[int], start: int, tail: bool) -> dict[int, tuple[int, str]]:
    """Cost and audit of the cheapest edits from a state. With ``tail`` rows may be inserted at the end, and the one result is for
    the best accepting state; without, there is one for each state that can be reached by consuming the last row."""
    n = len(initials)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (0 if faults[i] == FINE else DELETE if faults[i] < 2 else min(DELETE, CUT))
    heap: list[tuple[int, str, int, int, int]] = [(left[0], "", 0, start, 0)]
    done: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str]] = {}
    while heap:
        _, audit, i, state, cost = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if not tail:
                out[state] = (cost, audit)
                continue
            if state in ENDS:
                return {state: (cost, audit)}
        made = NEXT[state][1]
        steps = [(INSERT, "I", i, made)] if i < n or tail else []
        if i < n:
            steps.append((DELETE, "D", i + 1, state))
            if faults[i] not in (0, 1):
                charge = CUT if faults[i] == 2 else 0
                steps.append((REROLE + charge, "R", i + 1, made))
                if (kept := KEPT.get((state, initials[i]))) is not None:
                    steps.append((charge, "K", i + 1, kept))
        for c, letter, j, s in steps:
            if (j, s) not in done:
                heapq.heappush(heap, (cost + c + left[j], audit + letter, j, s, cost + c))
    return out


def applied(audit: str, roles: list[str], texts: list[str], state: int) -> tuple[list[tuple[str, str]], int]:
    """The repaired rows, and the state that they leave."""
    out, i = [], 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        role, to = NEXT[state]
        if e == "K":
            role, to = roles[i], KEPT[state, roles[i][:1]]
        out.append((role, "" if e == "I" else texts[i]))
        state, i = to, i + (e != "I")
    return out, state


def said(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in rows).encode("utf-8", "surrogatepass")


def _digest(role: str, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{role}\0{text}".encode("utf-8", "surrogatepass"))


def _summary(turns: list, initials: list[str], faults: list[int]) -> dict:
    known = [t for t in turns if t is not None]
    return {
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)), **{f: faults.count(i) for i, f in enumerate(FAULTS)},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
    }


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else min(last - first + 1 - turns, 2**63 - 1)


def _whole(turns: list, roles: list[str], texts: list[str]) -> dict:
    """The result of a conversation that is all here."""
    seen: set[bytes] = set()
    faults = []
    for r, t in zip(roles, texts, strict=True):
        d = _digest(r, t)
        faults.append(fault(t, d in seen))
        seen.add(d)
    initials = [r[:1] for r in roles]
    s = _summary(turns, initials, faults)
    ((cost, audit),) = cheapest(initials, faults, 0, True).values()
    return {"gaps": _gaps(s["first_turn"], s["last_turn"], s["turns"]), **{k: s[k] for k in (*FAULTS, "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(said(applied(audit, roles, texts, 0)[0])).hexdigest()}


def _arrow(fields: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(fields))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
    trimmed()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            yield from b.slice(at, 500).to_pylist()


def repair(turns: DataFrame) -> DataFrame:
    """For each conv_id: gaps of its turns, counts of faults and illegal neighbours, cost, audit and hash of the repair.

    ``turns`` has conv_id, turn, role, text and, if wanted, a boolean ``gone``: such a row only says that its conversation exists.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), gone.alias("gone"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("salt"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "salt")]
    ended = f"{COUNTS}, audit string, repaired_sha256 string"
    fields = f"conv_id {kind}, {ended}, part int, no int, turns array<long>, roles array<string>, texts array<string>"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def out() -> Iterator[dict]:
            held: tuple[list, list, list] = ([], [], [])
            conv, split, no, started = None, True, 0, False  # the first conversation of a task may have begun in the one before

            def chunk() -> dict:
                nonlocal no, held
                no += 1
                r = {"conv_id": conv, "part": part, "no": no, "turns": held[0], "roles": held[1], "texts": held[2]}
                held = ([], [], [])
                return r

            for r in _rows(batches):
                if started and r["conv_id"] != conv:
                    if split:
                        yield chunk()
                    else:
                        yield {"conv_id": conv} | _whole(*held)
                        held = ([], [], [])
                    split = False
                conv, started = r["conv_id"], True
                if r["gone"]:
                    continue
                for h, c in zip(held, ("turn", "role", "text"), strict=True):
                    h.append(r[c])
                if len(held[0]) == CHUNK:
                    split = True
                    yield chunk()
            if started:  # the last one may go on in the next task
                yield chunk()

        return _batches(out(), kinds, 200)

    kinds = _arrow(fields)
    done = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(first_pass, fields))
    names = ["conv_id", *[c.split()[0] for c in ended.split(", ")]]
    return done.where("part IS NULL").select(*names).unionByName(_joined(done.where("part IS NOT NULL"), kind).select(*names))


def _joined(chunks: DataFrame, kind: str) -> DataFrame:
    """The conversations that came in chunks: duplicates across chunks, edits by state, the fold, and the streamed hash."""
    key = "part int, no int"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for c in _rows(batches):
                mine = {}
                for i, (r, t) in enumerate(zip(c["roles"], c["texts"], strict=True)):
                    mine.setdefault(_digest(r, t), i)
                for d, i in mine.items():
                    yield {"conv_id": c["conv_id"], "part": c["part"], "no": c["no"], "at": i, "digest": d}

        return _batches(out(), digest_kinds, 10_000)

    digest_fields = f"conv_id {kind}, {key}, at int, digest binary"
    digest_kinds = _arrow(digest_fields)
    firsts = chunks.select("conv_id", "part", "no", "roles", "texts").mapInArrow(digests, digest_fields)
    seen = Window.partitionBy("conv_id", "digest").orderBy("part", "no")
    again = firsts.withColumn("nth", F.row_number().over(seen)).where("nth > 1").groupBy("part", "no").agg(F.collect_list("at").alias("again"))

    stats = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
    edits = f"conv_id {kind}, {key}, {stats}, starts array<int>, ends array<int>, costs array<long>, audits array<string>"

    def by_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for c in _rows(batches):
                known, mine, faults = set(c["again"] or ()), set(), []
                for i, (r, t) in enumerate(zip(c["roles"], c["texts"], strict=True)):
                    d = _digest(r, t)
                    faults.append(fault(t, d in mine or i in known))
                    mine.add(d)
                initials = [r[:1] for r in c["roles"]]
                found = [(s, e, *best) for s in NEXT for e, best in cheapest(initials, faults, s, False).items()]
                yield {k: c[k] for k in ("conv_id", "part", "no")} | _summary(c["turns"], initials, faults) | dict(zip(("starts", "ends", "costs", "audits"), map(list, zip(*found, strict=True)), strict=True))

        return _batches(out(), edit_kinds, 200)

    edit_kinds = _arrow(edits)

    steps = written(chunks.join(again, ["part", "no"], "left").mapInArrow(by_state, edits))
    picked = f"{key}, start int, audit string, conv_id {kind}, {COUNTS}"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(path: list, best: dict, stat: dict, conv: object) -> Iterator[dict]:
            tails = {s: (INSERT * n, "I" * n) for s, n in ((0, 0), (3, 0), (2, 1), (1, 2))}
            # equal costs: the audits before the tails are prefix-free, so their rank decides
            cost, _, state, tail = min((c + tails[s][0], rank, s, tails[s][1]) for s, (c, rank) in best.items())
            ways = []
            for chunk_key, back in reversed(path):
                start, audit = back[state]
                ways.append((chunk_key, start, audit))
                state = start
            counts = {k: stat[k] for k in (*FAULTS, "illegal")} | {"gaps": _gaps(stat["first_turn"], stat["last_turn"], stat["turns"]), "cost": cost}
            for i, ((part, no), start, audit) in enumerate(ways):
                yield {"part": part, "no": no, "start": start, "audit": audit + (tail if i == 0 else ""), "conv_id": conv} | (counts if i == 0 else {})

        def out() -> Iterator[dict]:
            conv, path, best, stat = None, [], {}, {}
            for c in _rows(batches):
                if not path or c["conv_id"] != conv:
                    if path:
                        yield from finish(path, best, stat, conv)
                    conv, path, best = c["conv_id"], [], {0: (0, 0)}
                    stat = {"first_turn": None, "last_turn": None, "turns": 0, "illegal": 0, "last": None, **dict.fromkeys(FAULTS, 0)}
                ways: dict[int, list] = {}
                for s, e, cost, audit in zip(c["starts"], c["ends"], c["costs"], c["audits"], strict=True):
                    if s in best:
                        ways.setdefault(e, []).append((best[s][0] + cost, (best[s][1], audit), s))
                least = {e: min(w) for e, w in ways.items()}
                rank = {e: i for i, (e, _) in enumerate(sorted(least.items(), key=lambda x: x[1][1]))}
                path.append(((c["part"], c["no"]), {e: (w[2], w[1][1]) for e, w in least.items()}))
                best = {e: (w[0], rank[e]) for e, w in least.items()}
                if c["first_turn"] is not None:
                    stat["turns"] += c["turns"] - (stat["last_turn"] == c["first_turn"])
                    stat["first_turn"] = c["first_turn"] if stat["first_turn"] is None else stat["first_turn"]
                    stat["last_turn"] = c["last_turn"]
                if c["first"] is not None:
                    stat["illegal"] += stat["last"] is not None and stat["last"] + c["first"] not in ("su", "ua", "au")
                    stat["last"] = c["last"]
                for k in (*FAULTS, "illegal"):
                    stat[k] += c[k]
            if path:
                yield from finish(path, best, stat, conv)

        return _batches(out(), picked_kinds)

    picked_kinds = _arrow(picked)

    ways = written(steps.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(fold, picked))
    pieces = f"conv_id {kind}, {key}, {COUNTS}, audit string, said binary"

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for c in _rows(batches):
                got = applied(c["audit"], c["roles"], c["texts"], c["start"])[0]
                yield c | {"said": said(got) if got else None}

        return _batches(({k: r[k] for k in piece_kinds.names} for r in out()), piece_kinds, 200)

    piece_kinds = _arrow(pieces)
    ended = f"conv_id {kind}, {COUNTS}, audit string, repaired_sha256 string"
    ended_kinds = _arrow(ended)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            conv, sha, audit, empty = None, None, [], True
            for c in _rows(batches):
                if sha is None or c["conv_id"] != conv:
                    conv, sha, audit, empty = c["conv_id"], hashlib.sha256(), [], True
                audit.append(c["audit"])
                if c["said"] is not None:
                    sha.update(c["said"] if empty else b"\n" + c["said"])
                    empty = False
                if c["cost"] is not None:  # its last chunk
                    yield {k: c[k] for k in ("conv_id", "gaps", *FAULTS, "illegal", "cost")} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        return _batches(out(), ended_kinds)

    text = ways.join(chunks.select("part", "no", "roles", "texts"), ["part", "no"]).mapInArrow(edited, pieces)
    out = text.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(hashed, ended)
    release(steps)
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with the faults that crc32(conv_id:turn) % 20 says; dropped ones are marked ``gone``."""
    said_ = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said_("conv_id"), F.lit(":"), said_("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said_("role").alias("role"), said_("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")
