"""The corpus operators against brute force, with nulls, empty and odd rows."""

import hashlib
import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from sableleaf.llm import components, counts, decontaminate, jaccard, licenses, lines, mixing, quality, sharding, token_files, urls
from sableleaf.llm.queries import QUERIES, URL_RULES, length_share

SCHEMA = "doc_id long, text string, source string, size int, h1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None):
    """Rows with columns whose names clash with those inside the operators."""
    rows = [(i, t, sources[i] if sources else f"s{i % 3}", -1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(50)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts += [None, "", " ", "a", "a b c d", "A b C d", texts[3], texts[3].upper(), "long " * 30000, "é日本\n\nx|y <|endoftext|> 'S it's\x0b\x85 z", "A, b.. C?! d., 3. x'. É. ́,a it's, <|ENDOFTEXT|>, q.", texts[5] + " tail", texts[5] + " other"]
    return texts, frame(spark, texts).unionByName(spark.createDataFrame([(None, "a b c d", None, 1, None), (7, texts[7], "s1", 1, "x")], SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_kernel(spark):
    texts, _ = odd(spark)
    f = quality.Features(pa.array(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    got = np.stack([f.get(k, np.arange(len(texts))) for k in names], 1).tolist()
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        w = WORD.findall(t)
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        assert row == [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full), len(full) - len(set(full)), len(cover)]


def test_quality(spark):
    texts, df = odd(spark)
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts) + 2 and quality.judge(empty(spark)).count() == 0
    kept = quality.keep(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in rows) > 0
    assert all(not r["kept"] for r in rows if r["base_failed"])
    a, b = quality.RULES, tuple(reversed(quality.RULES))
    f = quality.Features(pa.array(texts))
    assert (quality.cascade(f, a)[0] == quality.cascade(f, b)[0]).all()
    est = [{"rule": r.name, "cost": c, "selectivity": s} for r, c, s in zip(quality.RULES, (1, 1, 1, 1, 1), (0.1, 0.5, 0.0, 0.2, 0.3), strict=True)]
    assert [r.name for r in quality.ordered(quality.RULES, est)][:2] == ["repeated_windows", "repeated_lines"]


def test_jaccard(spark):
    r = random.Random(4)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 6, 40, 120]))] for _ in range(12)]
    texts = []
    for _ in range(90):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        texts.append(" ".join(w).upper() if r.random() < 0.2 else "  ".join(w))
    texts += [None, "", "\n"]
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    top[a] = top[b] = min(top[a], top[b])
        if all(top[top[i]] == top[i] for i in top):
            break
    df = frame(spark, texts)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), top[i]) for i in sets}
    kept = jaccard.dedupe(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted({i for i in top if top[i] == i})


def test_jaccard_links(spark):
    """All links between different sets come out, those within a component too; equal texts stand behind one id."""
    r = random.Random(7)
    base = [[f"w{r.randint(0, 400)}" for _ in range(160)] for _ in range(4)]
    texts = []
    for _ in range(40):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        texts.append(" ".join(w))
    texts += [texts[3], texts[9].upper(), None, ""]
    sets, first = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        if s and s not in first:
            first[s] = i
            sets[i] = s
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = frame(spark, texts)
    got = [(x["a"], x["b"]) for x in jaccard.jaccard_links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(sets)
    assert jaccard.jaccard_links(empty(spark)).count() == 0


def test_jaccard_orders():
    """No linked pair is lost by an order; pairs with hardly a common token mostly are."""
    r = np.random.default_rng(5)
    lost = 0
    for _ in range(400):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < r.uniform(0.5, 1)], r.integers(0, 2**63, int(r.integers(0, 1 + n // 8))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        bits = sum(int(a ^ b).bit_count() for a, b in zip(*(jaccard.signature(s).view(np.uint64).tolist() for s in (x, y)), strict=True))
        assert bits <= len(x) + len(y) - 2 * common
        for order in (lambda s: s[::-1], jaccard.other_order):
            assert sorted(order(x).tolist()) == x.tolist()
            if common and 100 * common >= 80 * (len(x) + len(y) - common):
                assert len(np.intersect1d(jaccard.marks(jaccard.prefix(order(x), 80)), jaccard.marks(jaccard.prefix(order(y), 80))))
        z = np.unique(np.concatenate([x[:1], r.integers(0, 2**63, n).astype(np.uint64)]))
        lost += not len(np.intersect1d(jaccard.prefix(x[::-1], 80), jaccard.prefix(z[::-1], 80)))
    key = b"\x01\x02\xff\x80\x00\x11\x22\xfe" + b"x" * 8
    assert jaccard._class(key) == int.from_bytes(key[:8], "little", signed=True) < 0
    assert lost > 300
    for n in range(1, 400):  # the long prefix: whatever its size, a partner's is no shorter than the counts need
        for m in range(int(jaccard.least_overlap(n, 80)), n + 1):
            assert jaccard.spare(n, 80) <= min(max(1, n // 10), max(1, m // 10)) and jaccard.spare(m, 80) <= max(1, m // 10)


def test_jaccard_shared_prefix_tokens():
    """Classes are told every long-prefix token that another class has: within a batch, across batches, copies apart."""
    r = np.random.default_rng(3)
    rows = [(int(c), np.unique(r.integers(0, 60, 8)).astype(np.int64)) for c in range(1, 40)]
    rows += [rows[0], rows[5]] + [(100 + i, np.array([10**6 + i])) for i in range(5)]
    packed = [p for k in range(0, len(rows), 7) for p in jaccard._scatter(3)([pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows[k : k + 7]]), pa.array([t.tolist() for _, t in rows[k : k + 7]])], ["cid", "prefix"])])]
    all_ = pa.Table.from_batches(packed)
    told = Counter()
    for b in set(all_.column("bucket").to_pylist()):
        told.update(jaccard._shared(all_.filter(pa.compute.equal(all_.column("bucket"), b))).column("cid").to_pylist())
    for c, tokens in dict(rows).items():
        want = sum(any(t in other.tolist() for d, other in rows if d != c) for t in tokens.tolist())
        assert want <= told[c] <= (want if c not in (1, 6) else 2 * want)


def test_jaccard_repeated_rows(spark):
    """Of rows that repeat an id one stays for each text; null ids and texts stay, a far row of a repeated id too."""
    a, b = "one two three four five six", "another text of quite other words here"
    rows = [(1, a), (1, a), (2, a), (3, b), (3, "x y z"), (None, a), (None, a), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "s", 0, "x") for i, t in rows], SCHEMA)
    kept = Counter((x["doc_id"], x["text"]) for x in jaccard.dedupe(df).collect())
    assert kept == Counter({(1, a): 1, (3, b): 1, (3, "x y z"): 1, (None, a): 2, (4, None): 1, (5, ""): 1})


def test_dedupe_keeps_the_smallest_id(spark):
    base = [f"w{k}" for k in range(60)]
    near = [*base[:59], "other"]
    rows = [(f"own{k}", k, " ".join(f"d{k}x{j}" for j in range(20))) for k in range(10, 300)]
    rows += [("a", 3, " ".join(base)), ("b", 1, " ".join(near)), ("c", 2, " ".join(base)), ("n", None, " ".join(base)), ("z", 400, None), ("y", 401, " ")]
    docs = spark.createDataFrame(rows, "extra string, doc_id int, text string")
    out = jaccard.dedupe(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert sorted(r.extra for r in out.collect()) == sorted(x for x, *_ in rows if x not in "ac")
    assert jaccard.dedupe(docs.limit(0)).count() == 0


def test_jaccard_empty(spark):
    assert jaccard.dedupe(empty(spark)).count() == 0
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edit_distance_within(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_line_dedup(spark, edits):
    r = random.Random(2 + edits)
    base = ["the quick brown fox jumps", "a" * 12, "é日本 some line", "short", "ab", "x", "abcab" * (60 if edits < 2 else 5)]

    def mutated(line):
        z = list(line)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k, p = r.randrange(3), r.randrange(len(z) + 1)
            z[p : p + (k < 2)] = [] if k == 1 else [r.choice("abé ")]
        return "".join(z)

    texts = [None, "", " \n\t"] + ["\n".join(r.choice(["", " ", mutated(r.choice(base)), mutated(r.choice(base))]) for _ in range(r.randint(1, 8))) for _ in range(45)]
    texts += [texts[5], "long " * 300 + "\n" + "long " * 299 + "lonG "] if edits < 2 else [texts[5]]
    df, seen, want, cut = frame(spark, texts), [], {}, {}
    for i, t in enumerate(texts):
        all_ = (t or "").split("\n")
        here = []
        for k, x in enumerate(all_):
            if WORD.search(x):
                if any(x == y or edits and abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits for y in seen):
                    here.append(k)
                seen.append(x)
        want[i] = (sum(1 for x in all_ if WORD.search(x)), here)
        cut[i] = t if t is None else "\n".join(x for k, x in enumerate(all_) if k not in here)
    assert {x["doc_id"]: (x["n_lines"], x["removed"]) for x in lines.line_dedup(df, edits=edits).collect()} == want
    out = lines.dedup_text(df, edits=edits)
    assert out.columns == df.columns and {x["doc_id"]: x["text"] for x in out.collect()} == cut
    assert lines.line_dedup(empty(spark), edits=edits).count() == 0


def test_line_dedup_repeated_rows(spark):
    """Rows that share an id, or id and text, are cut by their own lines; a null id comes first."""
    rows = [(1, "one good line\nanother line"), (1, "another line\nthird line here"), (1, "third line here"), (1, "third line here"), (None, "null comes first\none good line")]
    df = spark.createDataFrame([(i, t, "s", 0, "x") for i, t in rows], SCHEMA)
    got = sorted(y for x in lines.dedup_text(df).collect() for y in x["text"].split("\n") if y)
    assert got == ["another line", "null comes first", "one good line", "third line here"]


def test_decontaminate(spark):
    r = random.Random(3)
    items = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 8))) for _ in range(n)) for n in (20, 40, 60)] + ["tiny", "", None]
    clean = [" ".join("".join(r.choice("fghij") for _ in range(5)) for _ in range(50)) for _ in range(5)]
    texts, want = [None, "", *clean], set()
    for k, item in enumerate(items[:3]):
        budget, parts = decontaminate.pieces(decontaminate.normal(item))
        assert len(parts) == budget + 1 and "".join(p for _, p in parts) == decontaminate.normal(item)
        for _ in range(10):
            z = list(item)
            for _ in range(budget):
                z[r.randrange(len(z))] = r.choice("xyz日")
            want.add((len(texts), k))
            texts.append(clean[0] + "\n" + "".join(z).upper().replace("É", "é") + " " + clean[1])
    want.add((len(texts), 3))
    texts.append("a TINY one")
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, doc_id int")
    df = frame(spark, texts)
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(df, bench).collect()} == want
    many = lambda f: sorted(map(tuple, f(df, bench).collect()))
    one, decontaminate.BLOCK_CHARS = (many(decontaminate.find_leaks), decontaminate.BLOCK_CHARS), 1
    assert many(decontaminate.find_leaks) == one[0] and decontaminate.drop_leaks(df, bench).count() == len(texts) - len({d for d, _ in want})
    decontaminate.BLOCK_CHARS = one[1]
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {*range(len(texts))} - {d for d, _ in want}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(empty(spark), bench).count() == 0


def test_decontaminate_repeated_phrase():
    """A phrase that occurs twice in an item opens windows that end late but begin late; copies edited in front are found all the same."""
    r = random.Random(8)
    phrase = "which of the following statements is true about the"
    for _ in range(60):
        other = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(3, 7))) for _ in range(r.randint(4, 14))) for _ in range(3)]
        item = f"{other[0]} {phrase} {other[1]} {phrase} {other[2]}"
        k = decontaminate.pieces(item)[0]
        z = list(item)
        for _ in range(k):
            z[r.randrange(len(z) // 2)] = r.choice("xyz")
        text = f"some text {phrase} and more of it " + "".join(z) + " fghij" * 30
        want = decontaminate.myers(item, decontaminate.normal(text))
        assert want[0] <= k
        got = list(decontaminate._search(decontaminate.Index([(0, item)]), pa.array([text])))
        assert [(x[2], x[4]) for x in got] == [want]
    # one place in the text, two offsets in the item
    item = "abcdefghijklmnop" * 6
    text = "x" * 40 + item
    got = list(decontaminate._search(decontaminate.Index([(0, item)]), pa.array([text])))
    assert got == [(0, 0, 0, 40, 136)]


def test_decontaminate_random():
    """Every item within its budget of a whole text is found, and no other: short items, repeated pieces, several errors."""
    r = random.Random(9)
    found = 0
    for turn in range(300):
        unit = " ".join("".join(r.choice("abé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 6)))
        item = decontaminate.normal((unit + " ") * r.randint(1, 3) + "".join(r.choice("abcd ") for _ in range(r.randint(0, 30))))
        if not item:
            continue
        m = len(item)
        k = decontaminate.pieces(item)[0]
        assert k == min(int(m * 0.05), m - 1) and len(decontaminate.pieces(item)[1]) == k + 1
        z = list(item)
        for _ in range(r.randint(0, k + 1)):
            q, at = r.randrange(3), r.randrange(len(z) + 1)
            z[at : at + (q < 2)] = [] if q == 1 else [r.choice("abxyé")]
        text = "".join(r.choice("abxy .") for _ in range(r.randint(0, 40))) + r.choice(["", " "]) + "".join(z) + r.choice(["", " "]) + "".join(r.choice("abxy .") for _ in range(r.randint(0, 40)))
        own = decontaminate.normal(text)
        if k:
            least = min(edit_distance_within(item, own), m)
            want = least if least <= k else None
        else:
            want = 0 if re.search(("" if not item[0].isalnum() else r"(?<![^\W_])") + re.escape(item) + ("" if not item[-1].isalnum() else r"(?![^\W_])"), own) else None
        got = list(decontaminate._search(decontaminate.Index([(0, item)]), pa.array([None, text])))
        assert [x[2] for x in got] == ([] if want is None else [want]), (item, text)
        assert all(x[0] == 1 and edit_distance(item, own[x[3] : x[4]]) == x[2] for x in got)
        found += len(got)
    assert found > 100
    text = pa.array(["no destiny, yesterday", "tiny, yes"])
    assert [(x[0], x[1]) for x in decontaminate._search(decontaminate.Index([(0, "tiny"), (1, "yes")]), text)] == [(1, 0), (1, 1)]


def test_mix(spark):
    r = random.Random(6)
    texts = [" ".join(["w"] * r.randint(0, 80)) for _ in range(600)] + [None]
    sources = [r.choice(["a", "a", "a", "b", "c", "é", None]) for _ in texts]
    df = frame(spark, texts, sources)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts) and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)
    per, total = {}, sum(x["size"] for x in rows)
    for x in rows:
        assert x["taken"] <= 3 * x["size"]
        t = per.setdefault(x["source"], [x["source_size"], x["target"], 0])
        t[2] += x["taken"]
    assert abs(sum(t for _, t, _ in per.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s and 0 <= t - k + 1e-6 and t - k <= max(3, 0.01 * t) for s, t, k in per.values())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(x["copies"] for x in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_by_pareto_order(spark):
    """Each source's extra copies are those that one pass down the Pareto order finds room for; long documents leave no gap that a short one fills."""
    r = random.Random(12)
    sources = [x for x in "abc" for _ in range(300)]
    sizes = [r.randint(5, 40) for _ in sources]
    for x in "abc":
        sources += [x] * 4
        sizes += [3000] * 4
    df = frame(spark, [" ".join(["w"] * n) for n in sizes], sources)
    for share in (None, length_share):
        rows = mixing.mix(df, weights=(5, 2, 2), share_of=share).collect()
        for source in "abc":
            own = [x for x in rows if x["source"] == source]
            target, weight = own[0]["target"], {x["doc_id"]: (x["size"].bit_length() if share else 1) for x in own}
            low, high = 0.0, 3.0 * target
            for _ in range(200):  # the rate at which copies, three at the most, come to the target
                mid = (low + high) / 2
                low, high = (mid, high) if sum(min(3.0, mid * weight[x["doc_id"]]) * x["size"] for x in own) < target else (low, mid)
            e = {x["doc_id"]: min(3.0, low * weight[x["doc_id"]]) for x in own}
            certain = {i: int(v + 1e-9) for i, v in e.items()}
            left = target - sum(certain[x["doc_id"]] * x["size"] for x in own)
            rank = []
            for x in own:
                p = e[x["doc_id"]] - certain[x["doc_id"]]
                if p > 1e-6:
                    u = (int(hashlib.md5(f"mix|{x['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                    rank.append((u / (1 - u) / (p / (1 - p)), x["doc_id"], x["size"]))
            want = dict(certain)
            for _, i, n in sorted(rank):
                if n <= left:
                    want[i] += 1
                    left -= n
            assert {x["doc_id"]: x["copies"] for x in own} == want
            assert left < min([n for _, i, n in rank if want[i] == certain[i]], default=3)


def test_mixed_takes_what_mix_says(spark):
    """Rows told by the rules are those that the mix takes: repeated ids and rows, nulls, long documents and clashing names included."""
    r = random.Random(21)
    rows = [(i, " ".join([f"w{i}"] * r.choice([0, 3, 9, 30, 2000 if i % 97 == 0 else 12])), r.choice(["a", "a", "b", None]), i) for i in range(500)]
    rows += [(7, "x y z", "a", 1), (7, "x y z", "a", 2), (7, "x y w", "a", 3), (None, "n n", "b", 4), (None, "n n", "b", 5), (None, None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").withColumn("row", F.lit("r")).withColumn("gap", F.lit(1)).repartition(5)
    key = lambda x: (x["doc_id"], x["source"], mixing_words(x["text"]))
    for share in (None, length_share):
        want, got = Counter(), Counter()
        for x in mixing.mix(df, share_of=share).collect():
            want[x["doc_id"], x["source"], x["size"]] += x["copies"]
        out = mixing.mixed(df, share_of=share)
        assert out.columns == df.columns
        for x in out.collect():
            assert x["row"] == "r" and (x["doc_id"], x["text"], x["source"], x["size"]) in rows
            got[key(x)] += 1
        assert +want == got
    assert mixing.mixed(empty(spark)).count() == 0


def mixing_words(text):
    return len((text or "").split())


def test_mix_unequal_shares(spark):
    """Inclusion follows the shares: over many seeds a share of 3 is taken three times as often."""
    rows = [(i, "w w w w", "s", 3.0 if i % 2 else 1.0) for i in range(40)] + [(100 + i, "w w w w", "t", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, share double")
    taken = Counter()
    for seed in range(6):
        for x in mixing.mix(df, weights=(1, 3), seed=f"s{seed}", share_col="share").where("source = 's'").collect():
            taken[x["doc_id"] % 2] += x["copies"]
    assert 2 < taken[1] / taken[0] < 4.5


def test_shards(spark):
    texts, df = odd(spark)
    rows = sharding.shards(df, 8).collect()
    assert len(rows) == len(texts) + 2 and sharding.shards(empty(spark)).count() == 0
    for s in {x["shard"] for x in rows}:
        own = [x["slot"] for x in rows if x["shard"] == s]
        assert sorted(own) == list(range(len(own)))
    at = {}
    for x in rows:
        at.setdefault((x["text_crc32"], x["size"] > 1), set()).add(x["shard"])
    assert all(len(v) == 1 for k, v in at.items() if k[1])
    r = random.Random(1)
    sizes = [r.randint(1, 1000) for _ in range(3000)]
    part = sharding.assign(sizes, 8)
    sums = [sum(s for s, p in zip(sizes, part, strict=True) if p == k) for k in range(8)]
    assert max(sums) - min(sums) <= 8 and sharding.assign([], 8) == []
    # the method, step by step: the two partitions of largest spread, oppositely ordered
    assert sorted(sorted(x for x, p in zip([8, 7, 6, 5, 4], sharding.assign([8, 7, 6, 5, 4], 2), strict=True) if p == k) for k in (0, 1)) in ([[4, 5, 7], [6, 8]], [[4, 6, 7], [5, 8]], [[4, 5, 6], [7, 8]], [[4, 7], [5, 6, 8]])


def test_shards_balance(spark, monkeypatch):
    """Byte sums are near equal over many turns, and the same whatever the partitions are."""
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 40)
    monkeypatch.setattr(sharding, "FAN", 3)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 30)
    r = random.Random(4)
    texts = ["x" * r.randint(1, 400) + str(r.randint(0, 500)) for _ in range(1500)]
    df = frame(spark, texts)
    rows = sorted(map(tuple, sharding.shards(df, 8).collect()))
    assert rows == sorted(map(tuple, sharding.shards(df.repartition(3), 8).collect()))
    sums, count, at = Counter(), Counter(), {}
    for doc, size, _, shard, _ in rows:
        sums[shard] += size
        count[shard] += 1
        at.setdefault(texts[doc], set()).add(shard)
        assert size == len(texts[doc]) + 1
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 0.002 * sum(sums.values()) and all(len(x) == 1 for x in at.values())
    assert all(sorted(x[4] for x in rows if x[3] == k) == list(range(count[k])) for k in count)


def test_write_shards(spark, tmp_path):
    texts, df = odd(spark)
    sharding.write_shards(df, f"file://{tmp_path}/out", 3)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert set(got.columns) == {*df.columns, "shard", "slot"}
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "")
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=repr) == sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=repr)
    want = Counter((x["doc_id"], x["shard"], x["slot"]) for x in sharding.shards(df, 3).collect())
    assert Counter((x["doc_id"], x["shard"], x["slot"]) for x in got.collect()) == want and key


def test_components(spark):
    """Chains, hubs, reversed and repeated links, self links and nulls, against union by hand."""
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (500, 500), (31, 30), (30, 31)]
    top = {x: x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}
    for _ in top:
        for a, b in edges:
            if a in top and b in top:
                top[a] = top[b] = min(top[a], top[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(top) and {x["node"]: x["component"] for x in got} == top
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_files(spark):
    texts, df = odd(spark)
    path = P.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    ids = [e.ids + [1] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    own, n = token_files.WordTokenizer(path).encode(pa.array(texts))
    assert own.tolist() == [x for i in ids for x in i[:-1]] and n.tolist() == [len(i) - 1 for i in ids]
    for kind in ("byte", "bit"):
        out = pa.BufferOutputStream()
        w = token_files.Writer(out, kind)
        for k, i in enumerate(ids):
            w.text(k if k else None, np.array(i, np.uint32))
        w.close()
        got = token_files.Reader(pa.BufferReader(out.getvalue()))
        assert [x.tolist() for _, x in got.texts()] == ids and got.null.tolist() == [k == 0 for k in range(len(ids))]
        assert all(got.text(k).tolist() == ids[k] for k in (0, 5, 44, len(ids) - 1))
    rows = token_files.token_round_trip(df, path).orderBy("start").collect()
    assert [x["doc_id"] for x in rows] == [None, *sorted([*range(len(texts)), 7])]
    at = 0
    for x in rows:
        assert x["start"] == at
        at += x["n_tokens"]
        if x["doc_id"] is not None:
            assert x["n_tokens"] == len(ids[x["doc_id"]]) and x["ids_crc32"] == zlib.crc32(np.array(ids[x["doc_id"]], "<u4").tobytes())
    assert token_files.token_round_trip(empty(spark), path).count() == 0


def test_word_tokenizer_random(monkeypatch):
    """Word by word gives the library's ids of the whole text: odd signs, cases, white space, special strings, a full cache."""
    monkeypatch.setattr(token_files, "CACHE", 200)
    r = random.Random(1)
    parts = [*"abStéÉßÿ'’ \n\t\x0b\x0c\x85\xa0.!#<|>1٣日KſİﬁΣς̸=~^`_\x00😀\u200dª×÷", "  ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'re", "'LL", "word", "Été", "don't,"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(8000)]
    own = token_files.WordTokenizer(P.path("word_bpe_49k.json"))
    assert own.by_word and own.apart and own.plain
    want = [e.ids for e in own.lib.encode_batch_fast(texts, add_special_tokens=False)]
    for low in range(0, len(texts), 1000):
        ids, n = own.encode(pa.array([*texts[low : low + 1000], None]))
        assert np.split(ids, np.cumsum(n))[-1].tolist() == [] and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [*want[low : low + 1000], []]
    other = token_files.WordTokenizer(P.path("byte_bpe_50k.json"))
    assert not other.by_word
    ids, n = other.encode(pa.array(texts[:300]))
    assert ids.tolist() == [x for e in other.lib.encode_batch_fast(texts[:300], add_special_tokens=False) for x in e.ids]


def test_token_counts(spark):
    texts, df = odd(spark)
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = [x for x in counts.count_tokens(df, path).collect() if x["doc_id"] is not None]
    assert all(x["n_tokens"] == want[x["doc_id"]] and x["n_bytes"] == len((texts[x["doc_id"]] or "").encode()) for x in rows) and len(rows) == len(texts) + 1
    assert counts.count_tokens(empty(spark), path).count() == 0


def test_urls(spark):
    link = '<head><LINK rel="canonical" href="{}"></head>'
    pages = [
        (0, "http://A.example.com/en/x", None), (1, "http://www.example.com/en/", ""), (2, "https://x.org/a?b#c", link.format("http://sub.example.com/en/1")), (3, "http://x.org/a", "<p>"),
        (4, "http://y.org/1", '<meta http-equiv="refresh" content="0; url=/2">'), (5, "http://y.org/2", link.format("//z.net/es/q")), (6, "http://z.net/es/q", None), (7, "http://z.net/de/", None),
        (8, "http://w.org/", link.format("http://x.com/ok")), (9, "http://w.org/?q", link.format("http://z.net/fr/1")), (10, None, None), (11, "no scheme", link.format("http://z.net/fr/1")), (11, "no scheme", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {(x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.filter_urls(df, URL_RULES).collect()}
    assert got == {
        (0, "a.example.com", "/en/x", "example.com/en/", "block"), (1, "www.example.com", "/en/", "www.example.com/en/", "allow"), (2, "x.org", "/a", None, "block"), (3, "x.org", "/a", None, "block"), (4, "y.org", "/1", None, "block"),
        (5, "y.org", "/2", None, "block"), (6, "z.net", "/es/q", "net/es/", "block"), (7, "z.net", "/de/", None, "allow"), (8, "w.org", "/", None, "allow"), (9, "w.org", "/", None, "allow"), (10, "", "", None, "allow"), (11, "", "", None, "allow"),
    }
    more = spark.createDataFrame([("http://r.org/1", "http://r.org/2"), ("http://r.org/2", "http://a.net/fr/")], "from_url string, to_url string")
    one = spark.createDataFrame([(1, "http://r.org/1", None)], "page_id long, url string, html string")
    assert urls.filter_urls(one, URL_RULES, redirects=more).first()["verdict"] == "block"
    assert urls.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_licenses(spark):
    rows = [
        (0, "r/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software"), (1, "r/a.py", "code here"), (2, "r/b/c/d.py", "more"),
        (3, "r/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "r/b/e.py", "some words of a text that goes on for a while\nLicensed under the Apache License, Version 2.0.\nand then on and on"), (5, "q/z.py", "none"), (6, None, None), (7, "top.py", ""), (8, "rr/a.py", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {x["doc_id"]: (x["license"], x["origin"], x["declared_in"]) for x in licenses.scan_licenses(df, "path").collect()}
    assert got == {
        0: ("MIT", "file", "r/LICENSE"), 1: ("MIT", "inherited", "r/LICENSE"), 2: ("GPL-3.0", "inherited", "r/b/COPYING"), 3: ("GPL-3.0", "file", "r/b/COPYING"), 4: ("Apache-2.0", "header", "r/b/e.py"),
        5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None),
    }
    assert licenses.scan_licenses(df.limit(0), "path").count() == 0


def test_licenses_wrapped_and_whole(spark):
    """Notices that wrap, stand behind comment marks or inside a longer line; whole licences; names in passing are none."""
    prose = "some words of a text that goes on for a while about this and that " + " ".join(f"word{i}" for i in range(80))
    grant, gpl, bsd = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][1], licenses.TEMPLATES["BSD-3-Clause"][0]

    def wrapped(text, mark, width=72):
        return "\n".join(f"{mark} {x}" for x in textwrap.wrap(text, width))

    want = {
        0: (f"import os\n{wrapped(grant, '#')}\n{prose}", "MIT", "header"), 1: (f"{prose}\n{wrapped(gpl, ' *')}\n{prose}", "GPL-3.0", "header"), 2: (f"{wrapped(bsd, '//', 60)}\n{prose}", "BSD-3-Clause", "header"),
        3: (f"{prose} and is now much faster. Released under the MIT License. Thanks to all, {prose}", "MIT", "header"), 4: (f"{prose} the record was released under the same name {prose}", None, None),
        5: ("\n".join([prose] * 5), None, None),
    }
    for k, (name, (text,)) in enumerate(licenses.full_texts().items(), 6):
        want[k] = (text, name, "file")
    assert {"GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"} <= {x[1] for x in want.values()}
    df = spark.createDataFrame([(k, f"p{k}/x.txt", t) for k, (t, _, _) in want.items()], "doc_id long, path string, text string")
    got = {x["doc_id"]: (x["license"], x["origin"]) for x in licenses.scan_licenses(df, "path").collect()}
    assert got == {k: (name, origin) for k, (_, name, origin) in want.items()}


def test_licenses_cosine(spark):
    """The cosine of whole texts and lines, worked out from its definition."""
    templates = {"A": ["alpha beta gamma delta licence"], "B": ["beta beta epsilon licence text"]}
    texts = ["alpha beta gamma delta", "beta epsilon licence", "alpha alpha beta beta text\nsome other line", None, "", "omega " * 9 + "\nalpha beta gamma licence"]
    words = [re.findall(r"[a-z0-9]+", t or "") for t in texts]
    vocabulary = {w for x in templates.values() for w in x[0].split()}
    weight = lambda w: math.log((1 + len(texts)) / (1 + sum(w in own for own in words))) + 1 if w in vocabulary else math.log(1 + len(texts)) + 1

    def cosine(a, b):
        u, v = ({w: (1 + math.log(c)) * weight(w) for w, c in Counter(x).items()} for x in (a, b))
        return sum(x * v.get(w, 0) for w, x in u.items()) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())) if u else 0.0

    df = spark.createDataFrame([(k, f"d{k}/f.txt", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
    for x in licenses.scan_licenses(df, "path", templates=templates, header=0.3, whole=0.6).collect():
        own = words[x["doc_id"]]
        best = max(((cosine(own, t[0].split()), name) for name, t in templates.items()), default=(0, None))
        if best[0] >= 0.6:
            assert x["origin"] == "file" and x["license"] == best[1] and abs(x["cosine"] - best[0]) < 1e-9
        else:
            lines_ = [re.findall(r"[a-z0-9]+", z) for z in (texts[x["doc_id"]] or "").split("\n")]
            runs = [z[i : i + 5] for z in [own] for i in range(max(1, len(z) - 4))]
            top = max(cosine(z, t[0].split()) for z in lines_ + runs for t in templates.values())
            assert (x["license"] is not None) == (top >= 0.3) and (x["license"] is None or abs(x["cosine"] - top) < 1e-9)


def test_licenses_places(spark):
    """Places from a table: a row for each of a document's places, judged by each; ids and paths that are null join nothing."""
    notice = licenses.TEMPLATES["GPL-3.0"][0]
    prose = "some words of a text that goes on for a while " * 9
    docs = spark.createDataFrame([(1, notice), (2, "x"), (3, None), (4, "y"), (None, "z"), (5, f"{prose}\n{notice}\n{prose}"), (4, notice)], "doc_id long, text string")
    rows = [(1, "a/n"), (2, "a/b/x"), (2, "c/x"), (2, "c/x"), (3, "a/y"), (None, "a/z"), (4, None), (9, "a/9"), (5, "d/LICENSE"), (5, "e/f"), (3, "d/e/y"), (3, "e/y")]
    got = Counter((x["doc_id"], x["path"], x["license"], x["origin"], x["declared_in"]) for x in licenses.scan_licenses(docs, spark.createDataFrame(rows, "doc_id long, path string")).collect())
    assert got == Counter([
        (1, "a/n", "GPL-3.0", "file", "a/n"), (2, "a/b/x", "GPL-3.0", "inherited", "a/n"), (2, "c/x", None, None, None), (3, "a/y", "GPL-3.0", "inherited", "a/n"), (3, "d/e/y", "GPL-3.0", "inherited", "d/LICENSE"), (3, "e/y", None, None, None),
        (4, None, None, None, None), (4, None, "GPL-3.0", "file", None), (None, None, None, None, None), (5, "d/LICENSE", "GPL-3.0", "file", "d/LICENSE"), (5, "e/f", "GPL-3.0", "header", "e/f"),
    ])


def test_license_scan_inherits(spark, tmp_path):
    """The query's documents stand where pages show them, and inherit there."""
    notice = licenses.TEMPLATES["GPL-3.0"][0]
    texts = [notice, "one text", "another text", "a third", "a fourth", "a fifth", "a sixth", None]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    page_urls = [
        "http://A.example.org/en/0?page=2&ref=x", "https://a.example.org/en/1/", "http://a.example.org/en/sub/2.html#top", "http://a.example.org/de/3", "http://b.example.org/en/4", "http://a.example.org/en/4", "http://a.example.org/en/x5",
        "http://6", "a.example.org/en/6", None, "http://a.example.org/en/" + "9" * 30, "http://a.example.org/en/7#top", "http://a.example.org/en/7?x=/1",
    ]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(page_urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((x["doc_id"], x["path"], x["license"], x["origin"], x["declared_in"]) for x in QUERIES["op5_license_scan"](spark, str(tmp_path)).collect())
    at = "a.example.org/en/0"
    assert got == Counter([
        (0, at, "GPL-3.0", "file", at), (1, "a.example.org/en/1", "GPL-3.0", "inherited", at), (2, "a.example.org/en/sub/2.html", "GPL-3.0", "inherited", at), (3, "a.example.org/de/3", None, None, None),
        (4, "b.example.org/en/4", None, None, None), (4, "a.example.org/en/4", "GPL-3.0", "inherited", at), (5, None, None, None, None), (6, None, None, None, None), (7, "a.example.org/en/7", "GPL-3.0", "inherited", at),
    ])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    texts = {x["doc_id"]: x for x in docs.collect()}
    kept = {x["doc_id"] for x in quality.judge(docs).where("kept").collect()}
    group = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(docs.where(F.col("doc_id").isin(*kept))).collect()}
    kept = {i for i in kept if group[i] == i}
    items = [decontaminate.normal(x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i for i in kept if not any(decontaminate.myers(t, decontaminate.normal(texts[i]["text"]))[0] <= decontaminate.pieces(t)[0] for t in items)}
    assert {x["doc_id"] for x in out} <= kept
    copies = {x["doc_id"]: x["copies"] for x in mixing.mix(docs.where(F.col("doc_id").isin(*kept))).collect()}
    assert Counter(x["doc_id"] for x in out) == {i: c for i, c in copies.items() if c}
    assert json.dumps([x["start"] for x in sorted(out, key=lambda x: x["start"])][:1]) == "[0]"
