"""Each operator against a plain version, on a table with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from chromatile.llm import checks, decontam, langid, linededup, mixing, pii, quotes, simhash, substring, topk, warc
from chromatile.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASH = "k1 string, marks string, _id string, copy int, fp string, drops string, size string, target string, z string, key string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["the", "And", "of", "Ünder", "straße", "tion", "re", "x1", "éa"] + ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    passage = " ".join(rng.choices(vocab, k=40))
    line = "  A Line that Many documents share, é  "
    out = []
    for i in range(60):
        text = " ".join(rng.choices(vocab, k=rng.choice([1, 3, 15, 60])))
        if i % 4 == 0:
            text += "\n" + line.swapcase().strip() + "\n" + passage
        if i % 9 == 0 and out:
            text = out[-1][1]
        out.append((i, text, "ab"[i % 2], None if i % 7 == 0 else f"s{i % 4}"))
    out += [(70, None, "a", "s1"), (71, "", None, "s1"), (72, " \t\n ", "b", None), (73, "12 34 .", "a", "é"), (None, passage, "a", "s0")]
    out += [(74, " ".join(rng.choices(vocab, k=30_000)), "b", "s2"), out[5], out[5], (5, "another text of the same id " + passage, "a", "s1")]
    return [(d, t, g, s, None if t is None else len(t)) for d, t, g, s in out]


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", 1, "c", "c", "c", "c", "c", "c") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


def got(df, *cols):
    return sorted(([r[c] for c in cols] for r in df.collect()), key=repr)


def key(d):
    return 2**63 - 1 if d is None else d


def test_simhash_components(docs, rows):
    def fp(text):
        w = WORD.findall((text or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(r[1]) for r in rows]
    comp = [key(r[0]) for r in rows]
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4 and comp[j] < comp[i]:
                    comp[i], moved = comp[j], True
    want = sorted(([r[0], f"{f:016x}", None if c == key(None) else c] for r, f, c in zip(rows, fps, comp)), key=repr)
    assert got(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == want
    kept = sorted(([r[0]] for r, c in zip(rows, comp) if key(r[0]) == c), key=repr)
    assert got(simhash.keep_first(docs), "doc_id") == kept
    assert simhash.keep_first(docs).columns == docs.columns


def test_anchors_meet_and_crowded_anchors_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(40):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = {frozenset((a % 2**64, b % 2**64)) for a, b in got(simhash.links(df), "a", "b")}
    deep = {frozenset((a % 2**64, b % 2**64)) for a, b in got(simhash.links(df, max_group=3), "a", "b")}
    near = {frozenset((a, b)) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4}
    assert links <= near and deep <= near

    def parts(edges):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in map(tuple, edges):
            root[find(a)] = find(b)
        return {x: find(x) for x in fps}

    same = lambda p: {frozenset(x for x in fps if p[x] == r) for r in set(p.values())}
    assert same(parts(links)) == same(parts(near)) == same(parts(deep))


@pytest.mark.parametrize("n", [1, 5, 13, 30])
def test_substring_dedup(docs, rows, n):
    words = [WORD.findall(r[1] or "") for r in rows]
    low = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            low[k] = min(low.get(k, key(r[0])), key(r[0]))
    want = []
    for r, w in zip(rows, words):
        gone = {p for i in range(len(w) - n + 1) if low[tuple(w[i : i + n])] < key(r[0]) for p in range(i, i + n)}
        want.append([r[0], len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)])
    assert got(substring.substring_dedup(docs, n), "doc_id", "n_words", "n_removed", "text") == sorted(want, key=repr)


def plain_lines(rows, min_docs=3):
    keys = lambda t: [x.strip(" \t\n\v\f\r").translate(LOWER) for x in (t or "").split("\n")]
    held = {}
    for r in rows:
        for k in keys(r[1]):
            if len(k) >= 20:
                held.setdefault(k, set()).add(key(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x, k in zip(lines, keys(r[1])) if len(held.get(k, ())) < min_docs or key(r[0]) == max(held[k])]
        out.append([r[0], len(lines), len(lines) - len(stay), "\n".join(stay)])
    return sorted(out, key=repr)


def test_line_dedup(docs, rows):
    assert got(linededup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "text") == plain_lines(rows)
    kept = linededup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert [[d, t or ""] for d, t in got(kept, "doc_id", "text")] == sorted(([d, t] for d, _, _, t in plain_lines(rows)), key=repr)


def test_line_store_is_reversible(spark, docs, rows):
    one = [r for r in rows if key(r[0]) < 40]
    other = [r for r in rows if key(r[0]) >= 40]
    store = linededup.LineStore(spark, shards=3).insert(table(spark, one)).insert(table(spark, other))
    assert got(linededup._apply(docs, store.decisions(), 20, True).withColumn("doc_id", F.when(F.col("doc_id") < 2**62, F.col("doc_id"))), "doc_id", "n_lines", "n_dropped", "text") == plain_lines(rows)
    back = store.delete(table(spark, other).select("doc_id"))
    assert got(linededup._apply(table(spark, one), back.decisions(), 20, True), "doc_id", "n_lines", "n_dropped", "text") == plain_lines(one)
    assert got(back.refs, "k1", "k2", "n", "top") == got(linededup.LineStore(spark, shards=3).insert(table(spark, one)).refs, "k1", "k2", "n", "top")


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(-(2**63), 2**63, (2, 5000))
    layers = linededup.Layers([])
    layer = np.concatenate([layers.insert(k1[:2000], k2[:2000]), layers.insert(k1[2000:], k2[2000:])])
    layers = linededup.Layers(layers.dump())
    assert layers.contains(k1, k2).all()
    a, b = rng.integers(-(2**63), 2**63, (2, 20000))
    assert layers.contains(a, b).mean() < 0.01
    layers.delete(k1[:2500], k2[:2500], layer[:2500])
    assert layers.contains(k1[2500:], k2[2500:]).all()
    assert layers.contains(k1[:2500], k2[:2500]).mean() < 0.01


def test_mix(docs, rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = {}
    for r, n in zip(rows, size):
        total[r[3]] = total.get(r[3], 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    for s in order:
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == total[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    again = got(mixing.mix(docs.repartition(7)), "doc_id", "size", "target", "taken")
    assert again == got(mixing.mix(docs), "doc_id", "size", "target", "taken")
    copies = mixing.repeat_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r["source"]: r["n"] for r in copies.collect()} == {s: n for s in order if (n := sum(r["taken"] for r in out if r["source"] == s))}


def test_language_model_is_a_distribution_and_matches_a_plain_one():
    texts = {"a": b"abracadabra and abacus", "b": b"the theory of the thing"}
    parts = {k: [] for k in ("lang", "depth", "code", "n")}
    for i, t in enumerate(texts.values()):
        for depth in range(3):
            found = {}
            for p in range(depth, len(t)):
                code = int.from_bytes(t[p - depth : p + 1], "big")
                found[code] = found.get(code, 0) + 1
            for code, n in found.items():
                for k, v in zip(parts, (i, depth, code, n)):
                    parts[k].append(v)
    model = langid.Model(list(texts), {k: np.array(v) for k, v in parts.items()}, 2)
    p = np.exp2(-model.bits.astype(float)).reshape(model.nodes, model.size, 2)
    p[:, model.other] *= 256 - (model.size - 2)
    assert np.allclose(p.sum(1), 1, atol=1e-4)

    def plain(data, t, context):
        follow = {}
        for p in range(len(context), len(t)):
            if t[p - len(context) : p] == context:
                follow[t[p]] = follow.get(t[p], 0) + 1
        below = (lambda b: plain(b, t, context[1:])) if context else (lambda b: 1 / 256)
        if data in follow:
            n, q = sum(follow.values()), len(follow)
            rest = sum(below(b) for b in range(256) if b not in follow)
            return follow[data] / (n + q if rest > 0 else n)
        if not follow:
            return below(data)
        n, q = sum(follow.values()), len(follow)
        return q / (n + q) * below(data) / sum(below(b) for b in range(256) if b not in follow)

    sample = b"the abacus, zed"
    bits = model.lengths(np.frombuffer(sample, np.uint8), np.array([0, 3, 3, len(sample)]))
    for k, t in enumerate(texts.values()):
        want = [-np.log2(plain(sample[i], t, sample[max(s, i - 2) : i])) for s, e in ((0, 3), (3, len(sample))) for i in range(s, e)]
        assert bits[0, k] == pytest.approx(sum(want[:3]), abs=1e-2) and bits[1, k] == 0
        assert bits[2, k] == pytest.approx(sum(want[3:]), abs=1e-2)


def test_language_prediction(spark, docs, rows):
    out = {(r["doc_id"], r["held_out"], r["lang_pred"]) for r in langid.identify(docs).collect()}
    assert {(70, zlib.crc32(b"70") % 5 == 0, "und"), (71, zlib.crc32(b"71") % 5 == 0, "und"), (73, zlib.crc32(b"73") % 5 == 0, "und")} <= out
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h, _ in out if d is not None)
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def plain_distance(item, text):
    up = list(range(len(item) + 1))
    best = up[-1]
    for j, w in enumerate(text, 1):
        row = [j]
        for i, v in enumerate(item, 1):
            row.append(min(up[i] + 1, row[-1] + 1, up[i - 1] + (v != w)))
        up, best = row, min(best, row[-1])
    return best


def test_decontamination(spark):
    rng = random.Random(4)
    vocab = ["the", "of", "and", "in"] + ["".join(rng.choices("abcdefghij", k=7)) for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([6, 9, 15, 24, 40, 60] * 3)] + [(90, None), (91, "too short"), (None, " ".join(rng.choices(vocab, k=20)))]
    docs = [(i, " ".join(rng.choices(vocab, k=80))) for i in range(30)]
    planted = set()
    for i, (item, text) in enumerate(items):
        if text and len(text.split()) > 5:
            w = text.split()
            for edits in range(decontam.edits_allowed(len(w)) + 1):
                at = rng.randrange(len(w))
                if edits:
                    w[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [w[at], rng.choice(vocab)]])
                doc = 100 + 20 * i + edits
                docs.append((doc, ", ".join(rng.choices(vocab, k=12) + [x.upper() for x in w] + rng.choices(vocab, k=12))))
                planted.add((doc, item))
    docs += [(5, None), (6, ""), (None, items[4][1])]
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            x = words(x)
            k = decontam.edits_allowed(len(x))
            if len(x) >= 6 and any(plain_distance(x, w[s : s + len(x) + k]) <= k for s in range(len(w))):
                want.add((d, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.SLICE_WORDS, 100):
        out = decontam.contamination(df, bench, slice_words=size).collect()
        found = {(r["doc_id"], r["item_id"]) for r in out}
        assert found <= want and len(found) >= 0.97 * len(want)
        assert {(d, i) for d, i in want if d is None} <= found
        clean = {r["doc_id"] for r in decontam.keep_clean(df, bench, slice_words=size).collect()}
        assert clean == {d for d, _ in docs} - {d for d, _ in found}
    assert planted & want


def test_warc_round_trip(spark, tmp_path):
    body = "é" * 60
    pages = [(1, "http://a/\r\nX: y", body), (2, None, body), (3, "u", body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", body), (8, "u", "z" * 300_000), (9, "u", "WARC/1.1\r\n\r\n" * 20), (9, "u", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        first = min(same) if len(data) >= 100 else None
        revisit = first is not None and i != first
        want.append([i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None])
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got(warc.round_trip(df, archive_bytes=1000), *cols) == sorted(want, key=repr)
    assert got(warc.round_trip(df), *cols) == sorted(want, key=repr)
    folder = f"file://{tmp_path}"
    written = warc.write_archives(warc.plan_records(df).coalesce(1), f"{folder}/raw")
    index = warc.normalise(written, f"{folder}/normal").collect()
    raw = b"".join(zlib.decompressobj(31).decompress(p.read_bytes()) for p in sorted((tmp_path / "raw").iterdir()))
    normal = [p for p in (tmp_path / "normal").iterdir() if p.suffix == ".gz"]
    assert len(normal) == 1 and len((tmp_path / "normal" / (normal[0].name + ".idx")).read_text().splitlines()) == len(pages)
    data = normal[0].read_bytes()
    assert b"".join(zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31) for r in sorted(index, key=lambda r: r["offset"])) == raw
    with pytest.raises(ValueError):
        list(warc.split_records(iter([raw[:-7]])))


def test_top_inner_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 6))]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(400, None), (420, [1.0] * 5 + [None]), (440, [float("nan")] * 6), (460, [1.0]), (None, rows[1][1]), (480, [0.0] * 6), rows[20], (500, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string")
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v):
            good[i] = np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)
    want = []
    for q in good:
        if q % 20 == 0:
            best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:20]
            want += [[q, k, c, -s] for k, (s, c) in enumerate(best, 1)]
    assert got(topk.top_inner_products(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_quotes(spark):
    a, b = "First message, with a remark.", "Second paragraph here.\n\nAnother paragraph of it."
    rows = [
        (1, 0, "u", a), (1, 1, "a", f"> first  MESSAGE, with a\n> remark.\n{b}"), (1, 2, "u", "unrelated"),
        (1, 3, "u", f"> > {a}\n> another paragraph of it.\nreply to the second"), (1, 4, "a", "> nobody said this\nok"),
        (1, 5, "a", "> reply to the second"), (2, 0, "u", f"> {a}"), (1, 6, "x", None), (None, 3, "u", "n"), (1, None, "u", "> n"), (1, 6, "x", None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, source int")
    out = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(df).collect()}
    assert quotes.reply_ordered(df).count() == len(rows)
    reply = {k: r["reply_to"] for k, r in out.items()}
    assert reply == {(1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): 1, (1, 4): None, (1, 5): 3, (2, 0): None, (1, 6): None, (None, 3): None, (1, None): None}
    assert [out[1, t]["thread"] for t in range(7)] == [0, 0, 2, 0, 4, 0, 6]
    assert out[1, 1]["text"] == b and out[1, 3]["text"] == "reply to the second" and out[1, 6]["text"] == ""
    assert (out[1, 3]["n_passages"], out[1, 3]["n_linked"]) == (2, 2) and out[1, 4]["n_linked"] == 0


def test_check_sql_of_quotes(spark):
    a, b = "First message, with a remark.", "Second paragraph here.\n\nAnother paragraph of it."
    rows = [
        (1, 0, "u", a), (1, 1, "a", f"> first  MESSAGE, with a\n> remark.\n{b}"), (1, 2, "u", "unrelated"), (1, 4, "a", "> nobody\nok"),
        (1, 3, "u", f"> > {a}\n> another paragraph of it.\nreply to the second"), (1, 5, "a", "> reply to the second"), (2, 0, "u", f"> {a}"),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    out = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got(out, *out.columns) == sorted((list(r) for r in con.execute(checks.QUOTES).fetchall()), key=repr)


def luhn(s):
    return sum((d * 2 - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111; not 4111111111111112", "DE89370400440532013000 or DE89 3704 0044 0532 0130 00",
        "1999-12-31 31/12/1999 12/31/1999 31.12.1999 but 31.02.1999", "SSN 123-45-6789, none 000-12-3456", "+1 (017) 555-7713 (017) 555-7713",
        "10.0.0.1 not 300.1.1.1", "Mail John.Doe7@x.example.org now", None, "", "1 of 2 in 2024, v3.14", "x" * 100_000 + " 123-45-6789",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_replaced string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df).collect()}
    cards = re.findall(r"\d[\d -]{14,17}\d", out[0]["text"])
    plain = {re.sub(r"\D", "", c) for c in cards[:3]}
    assert len(plain) == 1 and luhn(plain.pop()) and out[0]["text"].endswith("4111111111111112") and out[0]["n_replaced"] == 3
    iban, spaced = out[1]["text"].split(" or ")
    assert iban == spaced.replace(" ", "") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE"
    dates = re.findall(r"\S+", out[2]["text"])
    y, m, d = dates[0].split("-")
    assert dates[1:] == [f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{d}.{m}.{y}", "but", "31.02.1999"] and dates[0] != "1999-12-31"
    assert out[3]["text"] != texts[3] and out[3]["text"].endswith("none 000-12-3456") and out[3]["text"][4:15] == out[10]["text"][-11:]
    assert out[4]["text"][3:17] == out[4]["text"][18:] and out[4]["text"] != texts[4] and out[5]["text"].endswith("not 300.1.1.1")
    assert re.fullmatch(r"Mail [A-Z][a-z]{3}\.[A-Z][a-z]{2}\d@x\.example\.org now", out[6]["text"]) and "John" not in out[6]["text"]
    assert [out[i]["text"] for i in (7, 8, 9)] == texts[7:10]
    assert pii.pseudonymise(df).collect() == pii.pseudonymise(df).collect()


def test_feistel_is_a_permutation(spark):
    df = spark.range(898 * 20).select("id", F.array((F.col("id") % 898).cast("int"), F.floor(F.col("id") / 898).cast("int")).alias("v"))
    moved = df.select(pii.feistel(F.col("v"), F.array(F.lit(898), F.lit(20)), "t").alias("p"))
    assert moved.distinct().count() == 898 * 20
    assert moved.filter("p[0] < 0 or p[0] >= 898 or p[1] < 0 or p[1] >= 20").count() == 0
    other = df.select(pii.feistel(F.col("v"), F.array(F.lit(898), F.lit(20)), "t", "other key").alias("p"))
    assert other.limit(50).collect() != moved.limit(50).collect()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        pii.pseudonymise(docs), mixing.mix(docs), mixing.repeat_documents(docs), langid.identify(docs), langid.keep_identified(docs), warc.round_trip(pages),
        decontam.contamination(docs, bench), decontam.keep_clean(docs, bench), linededup.dedup_lines(docs), linededup.without_repeated_lines(docs),
        quotes.reply_ordered(talk), topk.top_inner_products(vectors), simhash.simhash_components(docs), simhash.keep_first(docs), substring.substring_dedup(docs),
    ):
        assert df.count() == 0


def test_check_sql_on_the_small_fixture(docs, rows, tmp_path):
    """The SQL of the registered queries gives what the plain versions give."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows if r[0] is not None and r[0] != 5])
    lines = con.execute(checks.LINES).fetchall()
    want = plain_lines([r for r in rows if r[0] is not None and r[0] != 5])
    assert sorted(([d, n, m, s] for d, n, m, s in lines), key=repr) == sorted(([d, n, m, hashlib.sha256(t.encode()).hexdigest()] for d, n, m, t in want), key=repr)


def test_every_number_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
