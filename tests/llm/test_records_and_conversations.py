"""Archives of pages, the trie of conversation prefixes and the repair of conversations, each against a plain version."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from terrascore.llm import prefix_trie, queries, structure_repair, warc
from terrascore.llm.shared import new_path, ship

PAGE = "page_id long, url string, html string, id long, digest string, shard int, keeper string"
TURN = "conv_id long, turn long, role string, text string, turns int, key string, place long"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


# archives


def archived(pages, least=0):
    """What records of pages (id, html) without repeated ids must say."""
    best = {}
    for i, html in pages:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, html in pages:
        keeper, n = best.get(html or ""), len((html or "").encode())
        to = keeper if n >= least and keeper is not None and keeper != i else None
        out.append((i, n, sha1(html), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def some_pages():
    rows = [(i, f"http://x.org/{i}", f"<p>page {i % 40} {'y' * (i % 7)}</p>") for i in range(300)]
    rows += [(1000 + i, "http://hot.org/", "the same everywhere") for i in range(200)]  # two fifths of all rows
    rows += [(2000, None, None), (2001, "http://a.org/\r\nX-Evil: 1", ""), (2002, "http://b.org", "z" * 300_000), (None, "http://n.org", "only null"), (None, None, "the same everywhere")]
    return [(*r, 5, "d", 1, "k") for r in rows]


@pytest.mark.parametrize("least", [0, 12, 10**6])
def test_archive_reads_back_what_pages_say(spark, least):
    ship(spark)
    rows = some_pages()
    df = spark.createDataFrame(rows, PAGE)
    got = warc.archive_and_read(df, min_bytes=least, shard_bytes=3000, roll_bytes=4000)
    assert told(got) == archived([(r[0], r[2]) for r in rows], least)


def test_archive_is_the_same_however_rows_are_dealt(spark):
    ship(spark)
    df = spark.createDataFrame(some_pages(), PAGE)
    paths = [new_path(spark, "warc-test") for _ in range(2)]
    for path, rows in zip(paths, (df.repartition(7), df.orderBy("html").coalesce(1)), strict=True):
        warc.write_archive(rows, path, shard_bytes=3000, roll_bytes=2000)
    one, two = (sorted(map(tuple, warc.manifest(spark, p).collect())) for p in paths)
    assert one == two and len(one) > 5 and len({r[1] for r in one}) > 3
    folder = paths[0].removeprefix("file://")
    data = b"".join(open(f"{folder}/{r[0]}", "rb").read() for r in one)
    assert data == b"".join(open(f"{paths[1].removeprefix('file://')}/{r[0]}", "rb").read() for r in one)
    # ids ascend from file to file
    ids = []
    for r in one:
        with open(f"{folder}/{r[0]}", "rb") as f:
            ids += [int(x["page-id"]) for x, _ in map(warc.parse, warc.members(f)) if "page-id" in x]
    assert ids == sorted(ids)


def test_archive_holds_payloads_and_real_headers(spark):
    ship(spark)
    df = spark.createDataFrame(some_pages(), PAGE)
    path = new_path(spark, "warc-test")
    warc.write_archive(df, path, date="2024-02-29T00:00:00Z")
    rows = {r.page_id: r for r in warc.read_archive(spark, path).collect() if r.page_id is not None}
    assert rows[2002].payload == b"z" * 300_000 and rows[1199].payload == b"the same everywhere" and rows[1000].payload is None
    assert rows[2001].url == "http://a.org/%0D%0AX-Evil: 1" and rows[2000].url is None
    name = warc.manifest(spark, path).first().file
    with open(f"{path.removeprefix('file://')}/{name}", "rb") as f:
        fields = [x for x, _ in map(warc.parse, warc.members(f))]
    assert fields[0]["warc-type"] == "warcinfo" and all(x["warc-date"] == "2024-02-29T00:00:00Z" for x in fields)
    by_id = {x["warc-record-id"]: x for x in fields}
    assert len(by_id) == len(fields)
    for x in fields:
        if x["warc-type"] == "revisit":
            assert by_id[x["warc-refers-to"]]["warc-payload-digest"] == x["warc-payload-digest"]
    with pytest.raises(ValueError, match="already"):
        warc.write_archive(df, path)


def test_archive_of_repeated_ids_and_empty_tables(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, None, "x"), (1, "c", "y"), (0, "d", "x")], "page_id long, url string, html string")
    rows = sorted((r.page_id, r.url or "", r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect())
    assert rows == [(0, "d", "revisit", 1), (1, "", "revisit", 1), (1, "a", "revisit", 1), (1, "b", "response", None), (1, "c", "response", None)]
    assert warc.archive_and_read(df.where("false")).collect() == []


def test_damaged_archive_is_told(spark):
    ship(spark)
    path = new_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([(i, "u", f"text {i}") for i in range(50)], "page_id long, url string, html string"), path)
    name = f"{path.removeprefix('file://')}/{warc.manifest(spark, path).first().file}"
    data = open(name, "rb").read()
    open(name, "wb").write(data[:-9])
    with pytest.raises(Exception, match="size"):
        warc.read_archive(spark, path).collect()
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    good = warc.record(1, 0, "u", b"x", hashlib.sha1(b"x").digest(), "d", None)
    assert warc.parse(good)[1].endswith(b"\r\n\r\nx") and block.endswith(b"x")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good.replace(b"\r\n\r\nx\r\n", b"\r\n\r\ny\r\n"))


# prefixes


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda q: q[:2])] for c, v in conv.items()}
    made = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(conv.get(c - c % 100, [])[:h] + v[h:])
    nodes, children, leaves, saved, ends = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for c, v in made.items():
        ends[v].append(c)
        for k in range(len(v) + 1):
            nodes[v[:k]].append(c)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] += not children[p]
        if p:
            saved[p] += (len(nodes[p]) - 1) * len(p[-1][1])
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items())


def trie_rows(df, shard_turns):
    out = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.sequences(df)), shard_turns).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def talk(seed=3):
    """Conversations that begin alike, a third of them equal, one long, some of null or empty parts."""
    rnd, rows = random.Random(seed), []
    for c in range(400):
        n = rnd.randint(1, 12)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"say {rnd.randint(0, 1)} é" if t < 4 else f"own {rnd.randint(0, 3)}") for t in range(n)]
    rows += [(1000 + c, t, "user", f"the same {t}") for c in range(200) for t in range(9)]
    rows += [(5000, t, "user", f"long {t}") for t in range(500)] + [(5001, t, "user", f"long {t}") for t in range(499)]
    rows += [(6000, None, None, None), (6000, 1, None, "x"), (6100, 3, "", None), (None, 0, "user", "lost"), (7013, 0, "user", "short")]
    return [(*r, 1, "k", 2) for r in rows]


@pytest.mark.parametrize("shard_turns", [1 << 16, 700, 60])
def test_trie_equals_plain_version(spark, shard_turns):
    ship(spark)
    rows = talk()
    assert trie_rows(spark.createDataFrame(rows, TURN).repartition(5), shard_turns) == plain_trie(rows)


@pytest.mark.parametrize("shard_turns", [1 << 16, 40])
def test_trie_of_the_table(spark, sf, shard_turns):
    ship(spark)
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert trie_rows(df, shard_turns) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_repeated_rows_and_empty_tables(spark):
    ship(spark)
    rows = [(3, 0, "user", "a", 1, "k", 2)] * 3 + [(4, 0, "user", "a", 1, "k", 2)] * 2
    assert trie_rows(spark.createDataFrame(rows, TURN), 100) == plain_trie(rows)
    assert trie_rows(spark.createDataFrame([], TURN), 100) == []


# repairs

READS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def plain_repair(rows):
    """(cost, audit, result) of rows (initial, fault) by plain dynamic programming over strings; result: (role or None, row or None)."""
    best = {0: (0, "", ())}

    def least(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserts(now):
        for _ in range(4):
            after = dict(now)
            for state, (c, a, r) in now.items():
                for k in "ua":
                    if state in READS[k]:
                        least(after, READS[k][state], (c + 3, a + "I", (*r, (k, None))))
            now = after
        return now

    for row, (initial, fault) in enumerate(rows):
        after = {}
        for state, (c, a, r) in inserts(best).items():
            least(after, state, (c + 4, a + "D", r))
            for k in () if fault in ("blank", "duplicate") else READS:
                if state in READS[k]:
                    cut = 3 * (fault == "truncated")
                    if initial == k:
                        least(after, READS[k][state], (c + cut, a + "K", (*r, (None, row))))
                    if k != "s":
                        least(after, READS[k][state], (c + 3 + cut, a + "R", (*r, (k, row))))
        best = after
    best = inserts(best)
    return min(best[j] for j in (0, 3) if j in best)


def plain_reports(raw):
    conv, ids = defaultdict(list), set()
    for c, t, r, x, *_ in raw:
        ids.add(c)
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else x.translate({ord(s): None for s in ".!?"}) if k == 2 else x
        conv[c] += [] if k == 0 else [(t, "user" if k == 4 else r, x)] * (1 + (k == 3))
    out = []
    for c in ids:
        rows = sorted(conv[c], key=lambda q: (q[0] is not None, q[0] or 0))
        turns = [t for t, _, _ in rows if t is not None]
        seen, counts, told = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, r, x in rows:
            end = x.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            told.append((r[:1], fault))
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(told, told[1:], strict=False))
        cost, audit, result = plain_repair(told)
        text = "\n".join(f"{rows[k][1] if role is None else structure_repair.ROLES[role]}:{'' if k is None else rows[k][2]}" for role, k in result)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def repair_rows(spark, folder, rows=None):
    if rows is not None:
        spark.createDataFrame(rows, TURN).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_structure_repair(spark, str(folder)).collect()), key=str)


def test_repairs_of_the_table(spark, sf):
    raw = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repair_rows(spark, sf) == plain_reports(raw)


def test_repairs_of_odd_conversations(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", "system", "tool", "", None, "ux"]), f"{c} {t}" + rnd.choice([".", "!", "", " \n", "? \x0b"])) for c in range(150) for t in range(rnd.randint(1, 14))]
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one row a turn: other orders aren't fixed by the contract
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(900)]
    rows += [(901, 0, "system", None), (902, 5, "user", ""), (None, 0, "user", "who."), (None, 1, "assistant", "me"), (903, None, "user", "q."), (904, 0, "user", "same."), (904, 0, "user", "same.")]
    rows = [(*r, 1, "k", 2) for r in rows]
    assert repair_rows(spark, tmp_path, rows) == plain_reports(rows)


def test_repairs_of_an_empty_table(spark, tmp_path):
    assert repair_rows(spark, tmp_path, []) == []


def test_rules_share_matrices_and_change_nothing():
    rnd = random.Random(5)
    rules = ["ua", "", "xU", "au", ""]
    with_rules, without = structure_repair.Grammar(rules), structure_repair.Grammar([])
    for n in [*range(13)] * 40 + [150, 700]:
        symbols = "".join(rnd.choice(["u", "a", "ua", "uaua", "s", "o", "S", "U", "A", "O", "x"]) for _ in range(n))
        want = plain_repair([(x.lower() if x in "suaSUA" else "z", "blank" if x == "x" else "truncated" if x.isupper() else None) for x in symbols])[:2]
        assert with_rules.solve(symbols) == want == without.solve(symbols)
    assert with_rules.solve("ua" * 50_000 + "x") == (4, "K" * 100_000 + "D")
    assert len(with_rules.compress("ua" * 64)) == 16


def test_grammar_comes_from_all_strings(spark):
    ship(spark)
    strings = spark.createDataFrame([("uauauaua", 10), ("suauaua", 5), ("ooo", 3), ("x", 1)], "symbols string, n long")
    rules = structure_repair.learn_grammar(strings)
    assert rules[0] == "ua" and "oo" in rules and all(ord(c) < structure_repair.FIRST_RULE + k for k, pair in enumerate(rules) for c in pair)
    assert structure_repair.learn_grammar(strings.where("false")) == []


def test_ropes_are_ordered_as_their_texts():
    rnd = random.Random(2)

    def rope(text):
        if len(text) < 2:
            return structure_repair.Rope(text)
        k = rnd.randint(1, len(text) - 1)
        return rope(text[:k]) + rope(text[k:])

    for _ in range(2000):
        a, b = ("".join(rnd.choice("DK") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert (rope(a) < rope(b)) == (a < b) and str(rope(a)) == a
