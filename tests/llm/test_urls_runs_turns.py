"""Url filter, periodic runs and repaired conversations against plain versions, and their odd cases."""

import hashlib
import heapq
import math
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np

from sparkloom.llm import more_sql, periodic, queries, turn_repair, url_filter

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def lowered(text):
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    name = re.split("[/?#]", rest, maxsplit=1)[0]
    return lowered(name), re.split("[?#]", rest[len(name) :], maxsplit=1)[0]


def rule_of(name, place):
    best = None
    for rule in RULES:
        at, start = rule.split("/", 1)
        if (name == at or name.endswith("." + at)) and place.startswith("/" + start) and len(rule) > len(best or ""):
            best = rule
    return best


def symbols(text):
    out = []
    for c in lowered(text):
        out.append(ord(c) - 96 if "a" <= c <= "z" else 27 if c in string.digits else {".": 28, "/": 29, "-": 30}.get(c, 31))
    return [*out, 0]


def plain_judge(urls):
    texts = {"".join(split(u)): rule_of(*split(u)) for u in urls}
    seen, follow = Counter(), {}
    for text, rule in texts.items():
        if rule is None or int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 5 == 0:
            continue
        line = (0, 0, 0, *symbols(text))
        for i in range(3, len(line)):
            for k in range(4):
                key = (RULES[rule], line[i - k : i])
                seen[key] += 1
                follow.setdefault(key, Counter())[line[i]] += 1

    def chance(kind, before, x):
        p = 1 / 32
        for k in range(4):
            key = (kind, before[3 - k :])
            if seen[key]:
                p = (follow[key][x] + len(follow[key]) * p) / (seen[key] + len(follow[key]))
        return p

    def score(text):
        line = (0, 0, 0, *symbols(text))
        return sum(math.log(chance("allow", line[i - 3 : i], line[i]) / chance("block", line[i - 3 : i], line[i])) for i in range(3, len(line))) / (len(line) - 3)

    scores = {t: score(t) for t in texts}
    held = [(math.floor(scores[t] * 64), RULES[r]) for t, r in texts.items() if r and int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 5 == 0]
    good, bad = ([b for b, v in held if v == kind] for kind in ("allow", "block"))
    least = 0
    if good and bad:
        bins = sorted({b for b, _ in held})
        edges = [min(0, bins[0])] + [max(min(0, b), a + 1) for a, b in zip(bins, bins[1:])]
        least = min(edges, key=lambda t: (round(sum(b < t for b in good) / len(good) + 1 - sum(b < t for b in bad) / len(bad), 12), abs(t), t))
    verdict = lambda t: RULES[texts[t]] if texts[t] else "allow" if math.floor(scores[t] * 64) >= least else "block"
    return [(*split(u), texts["".join(split(u))], verdict("".join(split(u))), round(scores["".join(split(u))], 6)) for u in urls]


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x", "https://example.com/EN/x", "x://a.www.example.com/en/", "a://b://c.com/d", "http://com", "http://com/", "http://com?x",
    "http://badexample.com/en/", "http://example.com/en", "http://net/es/1", "http://a.net/es", "http://a.net/fr/", "http://é.org/ü\n/z#q://y.com/", "http://h.org/" + "ab/" * 5000, "http://ÀB.net/fr/?a", "http://t.com.net/en/",
]


def test_urls_against_plain_models(spark, sf):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()] + ODD_URLS * 2
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(rows).collect()}
    want = plain_judge(urls)
    assert len(got) == len(urls)
    for i, w in enumerate(want):
        assert got[i][:4] == w[:4] and abs(got[i][4] - w[4]) < 2e-6, (urls[i], got[i], w)


def test_urls_without_rules_or_rows(spark):
    rows = spark.createDataFrame([(1, "http://a.org/b", 5), (1, "http://a.org/b", 6)], "page_id long, url string, host int")
    assert [(r.rule, r.verdict, r.score) for r in url_filter.judge(rows).collect()] == [(None, "allow", 0.0)] * 2
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_url_models_tell_planted_sites(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('aeiourst')}.com/{word('aeiourst')}/{i}") for i in range(200)] + [(1000 + i, f"http://{word('xqzwvk')}.net/es/{word('xqzwvk')}/{i}") for i in range(200)]
    rows += [(2000 + i, f"http://{word('aeiourst')}.org/{word('aeiourst')}") for i in range(50)] + [(3000 + i, f"http://{word('xqzwvk')}.org/{word('xqzwvk')}") for i in range(50)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[2000 + i] == "allow" and got[3000 + i] == "block" for i in range(50))


def plain_runs(words):
    """All stretches of a period, by comparing all words at each distance."""
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found = {}
    for p in range(1, len(words) // 4 + 1):
        start = None
        same = (ids[p:] == ids[:-p]).tolist() + [False]
        if not any(same):
            continue
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            elif not equal and start is not None:
                if i + p - start >= max(6, 4 * p):
                    found.setdefault((start, i + p), p)
                start = None
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_op12(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_a_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 20000").collect()}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    want = {i: plain_op12(i, t) for i, t in docs.items()}
    assert {i: got[i] for i in want} == want and sum(w[1] > 0 for w in want.values()) > 5


def test_runs_of_odd_texts(spark):
    rng = random.Random(7)
    texts = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x " + "a b c " * 4 + "y", "a\u00a0b " * 6, "à " * 9, "a b " * 3000]
    for _ in range(300):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 3, 9])
        words = [rng.choice("abcdefghi"[:k]) for _ in range(n)]
        a, p = rng.randint(0, n), rng.randint(1, 12)
        texts.append(" ".join(words[:a] + [words[a + (i - a) % p] if a + (i - a) % p < n else "z" for i in range(a, n)]))
    docs = spark.createDataFrame([(None if i % 50 == 3 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()]
    assert len(got) == len(texts)
    for (_, n, runs, kept), text in zip(got, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        assert n == len(words) and runs == plain_runs(words) and kept == " ".join(w for i, w in enumerate(words) if i not in gone), text
    damaged = docs.select("doc_id", periodic.planted(docs.doc_id, docs.text).alias("text"))
    for r, (doc_id, *_), text in zip(damaged.collect(), got, texts, strict=True):
        sha = hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest()
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10:
            assert r.text == text
        elif not plain_runs((r.text or "").split(" ")):
            assert sha == plain_op12(doc_id, text)[-1]


def test_runs_survive_hashes_that_lie(monkeypatch):
    words = "a b a b a b a b c d e f a b a b a b a b x x x x x x".split()
    ids, first, _ = periodic.numbered([" ".join(words).encode()])
    want = plain_runs(words)
    assert periodic.find_runs(ids, first) == [want]
    monkeypatch.setattr(periodic.Prefixes, "same", lambda self, a, b, n: np.ones(len(a), bool))
    assert periodic.find_runs(ids, first) == [want]


def cheapest(rows):
    """(cost, audit, turns) of (role, text, fault) rows, by Dijkstra's search over rows and grammar states."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in moves:
                heapq.heappush(heap, (cost + 3, audit + "I", i, moves[state, role[0]], (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (state, role[:1]) in moves:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, moves[state, role[:1]], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in moves:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, moves[state, new[0]], (*out, (new, text))))


def plain_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of (turn, role, text) rows of one conversation."""
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
    seen, marked = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\r\x0b\x0c")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[0][:1], b[0][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(marked, marked[1:]))
    cost, audit, out = cheapest(marked)
    count = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def plain_op13(rows):
    convs = {}
    for conv, turn, role, text in rows:
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = convs.setdefault(conv, [])
        one = (turn, "user" if mark == 4 else role, "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text)
        held += [] if mark == 0 else [one] * (2 if mark == 3 else 1)
    return {c: plain_repair(r) for c, r in convs.items()}


def odd_conversations(seed=11):
    rng = random.Random(seed)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (0, None, "user", None), (-5, 2, "", ""), (-5, 2, "sys", "\u00a0"), (-5, 2**40, "a", "x!")]
    for conv in range(60):
        said = [rng.choice(["Yes.", "No!", "so", "", " \n", "Why? ", "é.", "x" * 50 + "."]) for _ in range(6)]
        for turn in range(rng.randint(1, 14)):
            place = rng.choice([turn, turn, turn, None, turn * 7])
            rows.append((conv, place, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", None]), rng.choice([*said, f"number {turn}."])))
    return rows + [(99, t, "user" if t % 3 else "assistant", f"turn {t}{'.' * (t % 5 > 0)}") for t in range(400)]


def rows_of(df):
    return {r.conv_id: tuple(r[c] for c in (*turn_repair.REPORT, "audit", "repaired_sha256")) for r in df.collect()}


def test_repair_against_search(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_turn_repair(spark, sf)) == plain_op13(given)


def test_repair_of_odd_rows_in_any_parts(spark):
    rows = odd_conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_op13(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert rows_of(turn_repair.repaired_after_damage(table)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_sql_of_odd_rows(tmp_path):
    rows = odd_conversations(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {r[0]: tuple(r[1:]) for r in con.execute(more_sql.OP13_SQL).fetchall()}
    assert got == plain_op13(rows)


def test_traces_by_parts_and_blocks(monkeypatch):
    rng = random.Random(5)
    for _ in range(1500):
        codes = bytes(rng.choice([1, 2, 1, 2, 1, 2, 0, 3, rng.randrange(16)]) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])))
        monkeypatch.setattr(turn_repair, "BLOCK", rng.choice([1, 2, 3, 64]))
        faults = ("", "truncated", "blank", "duplicate")
        cost, audit, _ = cheapest([("sua?"[c % 4], "", faults[c // 4]) for c in codes])
        letters, state = turn_repair.trace(codes)
        assert (turn_repair.price(letters, codes) + turn_repair.END[state], letters + "I" * (turn_repair.END[state] // 3)) == (cost, audit)
        cut = rng.randint(0, len(codes))
        one, two = codes[:cut], codes[cut:]
        first, middle = turn_repair.trace(one, turn_repair.before(turn_repair.matrix(two), turn_repair.END))
        second, end = turn_repair.trace(two, turn_repair.END, middle)
        assert first + second + "I" * (turn_repair.END[end] // 3) == audit
