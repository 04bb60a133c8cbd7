"""Repair of conversations whose rows were lost, emptied, cut short, repeated or given to the wrong role.

A repaired conversation's roles read ``(s?(ua)+)?``: maybe a system row, then user and assistant in turns, or nothing. The
cheapest edits are found by dynamic programming over the automaton of that pattern, in min-plus algebra:

1. Each conversation becomes a string of symbols, one a row: its role's initial, in upper case if the text is truncated, or
   ``x`` if it must go (blank or duplicate). Texts aren't moved for this, only two hashes of them.
2. Re-Pair: the most frequent pairs of neighbouring symbols over all distinct strings become rules, a few pairs that don't
   touch each other in a round, until a round finds no pair twice. Counting is a Spark aggregate; the grammar is of a
   bounded size (ROUNDS x PAIRS rules) and nothing else reaches the driver. The bound sets how much is shared, not what is found.
3. Each rule has one transfer matrix: for every two states of the automaton the cheapest (cost, audit) of its rows. It is the
   min-plus product of its two sides' matrices, made bottom-up once a task. Audits are ropes, shared between rules; equal
   costs are decided by the ropes' order. Two audits of the same rows and cost are never one the beginning of the other, so
   the least audit of a whole is made of least audits of its parts.
4. A conversation is the product of its compressed string; equal strings are solved once. Its audit then goes to the task that
   reads its texts in order and edits them as they stream by, so a conversation's texts are never held whole.

Costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant row 3; a truncated row that stays
adds 3. Symbols and hashes of one conversation (17 bytes a row) lie in one task.

Edge cases: a null role or text is one space; rows come in ascending turn, null first, equal turns by two hashes of (role, text); a null conv_id
is a conversation like others; an empty table gives an empty result. Columns of other names aren't read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, stored

#: Costs of edits, white space, and signs that end a sentence.
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
#: Fixed value: pairs of neighbouring initials that are in order.
LEGAL = frozenset(("su", "ua", "au"))
ROLES = {"u": "user", "a": "assistant"}
#: Rounds of Re-Pair and most rules a round; strings longer than LONG are multiplied as a balanced tree.
ROUNDS, PAIRS, LONG = 8, 32, 64
FIRST_RULE = 0xE000
KNOWN = 100_000
#: States: nothing yet, after system, after user, after assistant; what each may read.
STATES = 4
READS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
MOD, BASE = (1 << 127) - 1, 0x5DEECE66D1234567890ABCDEF


class Rope:
    """A string as a tree whose parts are shared, with a hash of its content."""

    __slots__ = ("code", "left", "power", "right", "size", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.size, self.code, self.power = len(text), 0, pow(BASE, len(text), MOD)
            for c in text:
                self.code = (self.code * BASE + ord(c)) % MOD
        else:
            self.size, self.power = left.size + right.size, left.power * right.power % MOD
            self.code = (left.code * right.power + right.code) % MOD

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope(left=self, right=other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                out.append(x.text)
            else:
                todo += (x.right, x.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """Order of strings; parts of equal content are passed over without a look inside."""
        mine, others = [self], [other]
        while mine and others:
            x, y = mine.pop(), others.pop()
            if x is y or (x.size == y.size and x.code == y.code):
                continue
            if x.left is None and y.left is None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.size > n:
                    mine.append(Rope(x.text[n:]))
                if y.size > n:
                    others.append(Rope(y.text[n:]))
            elif y.left is None or (x.left is not None and x.size >= y.size):
                mine += (x.right, x.left)
                others.append(y)
            else:
                others += (y.right, y.left)
                mine.append(x)
        return bool(others)


Matrix = list  # STATES * STATES of (cost, Rope) or None
NOTHING = Rope()


def better(a, b):
    """The cheaper of two entries, of equal ones the one of the lesser audit."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def product(a: Matrix, b: Matrix, rows: range = range(STATES)) -> Matrix:
    out: Matrix = [None] * (STATES * STATES)
    for i, k in itertools.product(rows, range(STATES)):
        if (x := a[STATES * i + k]) is not None:
            for j in range(STATES):
                if (y := b[STATES * k + j]) is not None:
                    at = STATES * i + j
                    if out[at] is None or x[0] + y[0] <= out[at][0]:
                        out[at] = better(out[at], (x[0] + y[0], x[1] + y[1]))
    return out


def _inserts() -> Matrix:
    """Any number of inserted rows: the closure of single ones."""
    one: Matrix = [None] * (STATES * STATES)
    for i in range(STATES):
        one[STATES * i + i] = (0, NOTHING)
        for r in ROLES:
            if i in READS[r]:
                one[STATES * i + READS[r][i]] = (INSERT, Rope("I"))
    return product(product(one, one), one)


INSERTS = _inserts()


def matrix_of(symbol: str) -> Matrix:
    """The transfer matrix of one row: inserts before it, then its own edit."""
    own: Matrix = [None] * (STATES * STATES)
    delete, keep, retype = Rope("D"), Rope("K"), Rope("R")
    cut = CUT if symbol.isupper() else 0
    for i in range(STATES):
        own[STATES * i + i] = (DELETE, delete)
        for r in () if symbol == "x" else READS:
            if i in READS[r]:
                at = STATES * i + READS[r][i]
                if symbol.lower() == r:
                    own[at] = better(own[at], (cut, keep))
                if r in ROLES:
                    own[at] = better(own[at], (RETYPE + cut, retype))
    return product(INSERTS, own)


class Grammar:
    """Rules over symbols, oldest first: rule k, written as the character FIRST_RULE + k, stands for two symbols or rules before it."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices: dict[str, Matrix] = {s: matrix_of(s) for s in "suaoSUAOx"}
        for k, pair in enumerate(rules):
            self.matrices[chr(FIRST_RULE + k)] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        self.known: dict[str, tuple[int, str]] = {}

    def compress(self, symbols: str) -> str:
        for k, pair in enumerate(self.rules):
            if pair in symbols:
                symbols = symbols.replace(pair, chr(FIRST_RULE + k))
        return symbols

    def solve(self, symbols: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair, of equal ones that of the least audit."""
        if (have := self.known.get(symbols)) is not None:
            return have
        parts = [self.matrices[s] for s in self.compress(symbols)]
        while len(parts) > LONG:
            made: dict[tuple[int, int], Matrix] = {}
            for a, b in zip(parts[::2], parts[1::2], strict=False):
                if (id(a), id(b)) not in made:
                    made[id(a), id(b)] = product(a, b)
            parts = [made[id(a), id(b)] for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) & ~1 :]
        state: Matrix = [(0, NOTHING) if i == 0 else None for i in range(STATES * STATES)]
        for m in [*parts, INSERTS]:
            state = product(state, m, range(1))
        best = None
        for j in ENDS:
            best = better(best, state[j])
        out = (best[0], str(best[1]))
        if len(symbols) <= LONG and len(self.known) < KNOWN:
            self.known[symbols] = out
        return out


def pair_counts(symbols: str) -> Counter[str]:
    """How often each pair of neighbours occurs, without overlaps of itself."""
    found = Counter(map("".join, zip(symbols, symbols[1:], strict=False)))
    for pair in found:
        if pair[0] == pair[1]:
            found[pair] = symbols.count(pair)
    return found


def learn_grammar(strings: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[str]:
    """Re-Pair over (symbols, n): each round counts neighbours in all strings and takes the most frequent pairs that share no symbol."""
    rules: list[str] = []
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], rules=tuple(rules)) -> Iterator[pa.RecordBatch]:
            total: Counter[str] = Counter()
            for b in batches:
                for symbols, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k, pair in enumerate(rules):
                        symbols = symbols.replace(pair, chr(FIRST_RULE + k))
                    for pair, m in pair_counts(symbols).items():
                        total[pair] += n * m
            if total:
                yield pa.RecordBatch.from_pydict({"pair": list(total), "n": list(total.values())})

        counts = strings.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * pairs).collect()
        used: set[str] = set()
        for row in counts:
            if len(used) < 2 * pairs and not used & set(row.pair):
                used |= set(row.pair)
                rules.append(row.pair)
        if not counts:
            break
    return rules


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in, for tests: (conv_id, turn, role, text, lost). By crc32("conv_id:turn") modulo 20: 0 loses the row (it stays,
    marked), 1 empties its text, 2 takes out its stops, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    c = conversations
    some = lambda x: F.coalesce(c[x].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), kind.alias("__k"))
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text"))
    copies = F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("__k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("__k") == 0).alias("lost"), F.explode(copies).alias("__copy")).drop("__copy")


def _hashes() -> list:
    return [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "role", "text").alias("h2")]


PROFILE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string"
_PROFILE = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("symbols", pa.string())])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its rows in order."""
    out, key, state = [], object(), None

    def close() -> dict:
        turns, low, high, n = state["turns"]
        return {"conv_id": key, "gaps": high - low + 1 - turns if n else 0, **{k: state[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "symbols": "".join(state["symbols"])}

    for b in batches:
        for conv, turn, initial, empty, cut, h1, h2, lost in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            if state is None or conv != key:
                if state is not None:
                    out.append(close())
                key, last, seen, at = conv, None, set(), None
                state = {"turns": (0, 0, 0, 0), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "symbols": []}
            if lost:
                continue
            if turn is not None:
                turns, low, _, n = state["turns"]
                state["turns"] = (turns + (turn != at), low if n else turn, turn, n + 1)
                at = turn
            if last is not None and last + initial not in LEGAL:
                state["illegal"] += 1
            last = initial
            again = (h1, h2) in seen
            seen.add((h1, h2))
            fault = "blank" if empty else "duplicate" if again else "truncated" if cut else None
            if fault:
                state[fault] += 1
            letter = initial if initial in READS else "o"
            state["symbols"].append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, _PROFILE)
            out = []
    if state is not None:
        out.append(close())
        yield pa.RecordBatch.from_pylist(out, _PROFILE)


def profiles(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, symbols) of rows (conv_id, turn, role, text, lost); lost rows count for nothing but that
    their conversation is there. Each row counts for its first fault: blank, duplicate (role and text were there before), truncated."""
    end = F.rtrim("text", F.lit(SPACE))
    told = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (end == "").alias("empty"), (~F.substring(end, -1, 1).isin(*STOPS)).alias("cut"), *_hashes(), "lost")
    return told.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "h1", "h2").mapInArrow(_profile, PROFILE)


REPORT = PROFILE.replace("symbols string", "cost long, audit string")


def report(rows: DataFrame) -> DataFrame:
    """profiles() with the cheapest repair's cost and audit (the edits' initials in order) in place of the symbols."""
    found = stored(profiles(rows), "profiles")
    rules = learn_grammar(found.groupBy("symbols").agg(F.count("*").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = None
        for b in batches:
            grammar = grammar or Grammar(rules)
            solved = [grammar.solve(s) for s in b.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], names=[*b.schema.names[:6], "cost", "audit"])

    out = stored(found.mapInArrow(run, REPORT), "repairs")
    drop_stored(found)
    return out


REPAIRED = "conv_id long, place long, edit string, role string, text string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of repaired conversations, in order: each conversation's audit comes first, then its rows."""
    audit, at, place, expect, key, out, size = "", 0, 0, "u", None, [], 0

    def put(edit: str, role: str | None, text: str) -> None:
        nonlocal place, expect, size
        if edit == "K":
            expect = "a" if role[:1] == "u" else "u"
        else:
            role, expect = ROLES[expect], "a" if expect == "u" else "u"
        out.append({"conv_id": key, "place": place, "edit": edit, "role": role, "text": text})
        place, size = place + 1, size + len(text)

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put("I", None, "")
            at += 1

    for b in batches:
        for conv, kind, plan, role, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if kind == 0:
                inserts()
                audit, at, place, expect, key = plan, 0, 0, "u", conv
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(edit, role, text)
            if len(out) >= 2000 or size >= 4_000_000:
                yield pa.RecordBatch.from_pylist(out, _REPAIRED)
                out, size = [], 0
    inserts()
    if out:
        yield pa.RecordBatch.from_pylist(out, _REPAIRED)


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations' rows. A conversation's rows are in one partition, in order.

    rows: as for profiles(); reports: report() of the same rows."""
    none = lambda kind: F.lit(None).cast(kind)
    plans = reports.select("conv_id", F.lit(0).alias("kind"), "audit", none("string").alias("role"), none("string").alias("text"), none("long").alias("turn"), none("long").alias("h1"), none("long").alias("h2"))
    texts = rows.where("not lost").select("conv_id", F.lit(1).alias("kind"), none("string").alias("audit"), "role", "text", "turn", *_hashes())
    both = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "h1", "h2")
    return both.select("conv_id", "kind", "audit", "role", "text").mapInArrow(_edit, REPAIRED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    key, state, out = None, None, []
    for b in batches:
        for conv, place, role, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
            if place == 0:
                if state is not None:
                    out.append({"conv_id": key, "repaired_sha256": state.hexdigest()})
                key, state = conv, hashlib.sha256()
            state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if state is not None:
        out.append({"conv_id": key, "repaired_sha256": state.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired()'s rows as they come: the hash of role:text, joined by newlines. Empty conversations have no row."""
    return rows.mapInArrow(_digest, "conv_id long, repaired_sha256 string")
