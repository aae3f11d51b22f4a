"""Operators on texts against brute force, on small made-up tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, lm_score, media, mixing, ngram_join, packing, quality, suffix_dedup, url_filter

DDL = "doc_id long, text string, lang string, source string, n_chars long, tokens int, part int, n int, kind int, size int"


def docs(spark, rows):
    """Documents with more columns, whose names operators use inside."""
    full = [(d, t, "en", s, len(t or ""), 1, 2, 3, 4, 5) for d, t, s in rows]
    return spark.createDataFrame(full, DDL)


def hard_rows():
    rng = random.Random(4)
    words = ["ab", "cde", "f", "ghij", "Ü", "Zz"]
    base = " ".join(rng.choice(words) for _ in range(120))
    rows = [(0, None, None), (1, "", "b"), (2, "   \n\t", "a"), (3, "one", "a"), (4, base, None), (5, base, "b"), (6, base + " tail", "b"), (7, base[:200] + " xyz " + base[200:], "a"), (8, "ab " * 3000, "hot"), (9, base * 3, "hot")]
    for k in range(10, 40):
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w), "hot"))
    return rows


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# suffix-array dedup


def brute_windows(texts, t):
    seen, out = set(), []
    for x in texts:
        own = []
        for i in range(len(x) - t + 1):
            own.append(x[i : i + t] in seen)
            seen.add(x[i : i + t])
        out.append(own)
    return out


def test_core_against_brute_force():
    rng = random.Random(3)
    for k in range(40):
        t, letters = rng.choice([5, 8, 12]), b"ab" if k % 2 else b"abcdefgh"
        base = bytes(rng.choice(letters) for _ in range(60))
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 20))) + base[a : a + rng.randint(0, 40)] * rng.randint(0, 2) for a in (rng.randint(0, 50) for _ in range(rng.randint(0, 8)))]
        assert [x.tolist() for x in suffix_dedup.repeats(texts, t)] == brute_windows(texts, t)


def test_runs_hold_every_window_once():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) for _ in range(30)]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    r = suffix_dedup.runs(raw, at, 20, 8)
    key_of = {}
    for key, d, s, n, inner in zip(*(r[c].tolist() for c in ("key", "text", "start", "windows", "inner"))):
        own = [texts[d][s + i : s + i + 20] for i in range(n)]
        assert all(len(w) == 20 for w in own) and (inner or len(set(own)) == n)
        assert all(key_of.setdefault(w, key) == key for w in own)
    assert r["windows"].sum() == sum(max(0, len(t) - 19) for t in texts)


@pytest.mark.parametrize("more", [{}, {"hot": 0, "block": 50}])
def test_dedup_against_brute_force(spark, more):
    rows, t = [*hard_rows(), (5, "again", "b"), (5, "again", "b"), (None, "null id " * 9, "b")], 20
    seen, want = set(), []
    for d, x in sorted(((d if d is not None else -(1 << 63), (x or "").encode()) for d, x, _ in rows)):
        gone = bytearray(len(x))
        for i in range(len(x) - t + 1):
            if x[i : i + t] in seen:
                gone[i : i + t] = b"\1" * t
            seen.add(x[i : i + t])
        kept = bytes(b for b, g in zip(x, gone) if not g)
        want.append((None if d == -(1 << 63) else d, len(x), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.dedup(docs(spark, rows), threshold=t, mer=8, **more)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    part = suffix_dedup._Part(__import__("pyarrow").table({"doc_id": [1, 2], "t": [b"abcdefghij" * 100, b"xy"]}))
    covered = sorted(int(s) + int(x) for raw, at, _, shift in part.stretches(20) for s in shift for x in range(max(0, len(raw) - 19)) if len(raw) > 2)
    assert covered == list(range(981))


# shingle join


def brute_components(rows, percent=75):
    sets = []
    for _, t, _ in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("more", [{}, {"large": 4}])
def test_join_against_brute_force(spark, more):
    rows = [*hard_rows(), (50, "a b c", "a"), (51, "A b  C", "a"), (52, "a b", "a")]
    assert sorted(map(tuple, ngram_join.join(docs(spark, rows), **more).collect())) == brute_components(rows)


def test_thinned_chains(spark):
    """Texts that each differ a little more from the first: links reach only the nearer ones."""
    w = [f"w{k}" for k in range(200)]
    rows = [(500 - k, " ".join(["x%d" % i if i < 4 * k else x for i, x in enumerate(w)]), "s") for k in range(30)]
    rows += [(600 + k, " ".join(w[:150] + ["y%d_%d" % (k, i) for i in range(20 + k)]), "s") for k in range(20)]
    want = brute_components(rows)
    for large in (3, 10, 1000):
        assert sorted(map(tuple, ngram_join.join(docs(spark, rows), large=large).collect())) == want


def test_groups_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        v = rng.randint(5, 60)
        base, sets = rng.sample(range(v * 3), v), []
        for _ in range(rng.randint(2, 40)):
            b = set(base) if rng.random() < 0.7 else set(rng.sample(range(v * 3), rng.randint(1, v)))
            for _ in range(rng.randint(0, max(1, v // 6))):
                b.discard(rng.choice(list(b) or [0]))
                b.add(rng.randint(0, v * 3))
            sets.append(frozenset(b))
        sets = list(dict.fromkeys(sets))
        held = {x: sum(x in s for s in sets) for s in sets for x in s}
        shared = [np.array(sorted((x for x in s if held[x] > 1), key=lambda x: (held[x], x)), np.uint64) for s in sets]
        prefix = [max(0, len(s) - ngram_join.least_overlap(len(s)) + 1 - (len(s) - len(t))) for s, t in zip(sets, shared)]
        if len(sets) < 2:
            continue
        got = ngram_join.link_groups(shared, prefix, [len(s) for s in sets])
        want = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if 100 * len(a & b) >= 75 * len(a | b):
                        want[i] = want[j] = min(want[i], want[j])
        assert got.tolist() == want


def test_empty_tables(spark):
    empty = docs(spark, []).where("doc_id is not null")
    assert ngram_join.join(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0
    assert lm_score.score(empty).count() == 0
    assert media.digest(media.store(empty)).count() == 0
    assert mixing.mix(empty).count() == 0
    assert packing.pack(packing.pieces(empty)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(empty, labels).count() == 0
    assert chat_format.digest(chat_format.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# media


def test_media_round_trip(spark):
    rows = hard_rows()
    got = {r.doc_id: r for r in media.digest(media.store(docs(spark, rows))).collect()}
    for d, t, _ in rows:
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].feature == got[5].feature
    table = media.packet_table(media.store(docs(spark, rows))).where("doc_id = 9").orderBy("packet").collect()
    assert sum(r["size"] for r in table) == got[9].payload_bytes
    assert [r.timestamp_ns for r in table] == [64_000_000 * k for k in range(len(table))]


@pytest.mark.parametrize("kind", ["xiph", "ebml", "fixed", "none"])
def test_lacing(kind):
    frames = [b"a" * 300, b"b" * 5, b"c" * 700] if kind in ("xiph", "ebml") else [b"abcd"] * 3 if kind == "fixed" else [b"xyz"]
    if kind == "xiph":
        sizes = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
        flag, body = media.XIPH_LACING, bytes([2]) + sizes + b"".join(frames)
    else:
        flag, body = media.lace(frames)
    block = b"\x81" + (5).to_bytes(2, "big") + bytes([flag]) + body
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block))
    open_cluster = media.CLUSTER.to_bytes(4, "big") + b"\xff" + media.uint(media.TIMESTAMP, 10) + group  # of unknown size
    raw = media.HEADER + media.element(media.SEGMENT, media.FRONT + open_cluster + media.element(media.CUES, b""))
    got = media.packets(raw)
    assert [raw[p.start : p.start + p.size] for p in got] == frames and got[0].timestamp_ns == 15_000_000


def test_broken_media():
    raw = media.write_mkv(media.pad(b"x" * 1000))
    for bad in (b"", b"\x00" * 20, raw[:-10], raw[:100]):
        with pytest.raises(ValueError):
            media.packets(bad)


# mixing


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["a", "b", None, "hot", "hot", "hot"])) for k in range(600)] + [(1000, None, "only null")]
    got = mixing.mix(docs(spark, rows), shard_docs=32)
    assert got.count() == len(rows)
    names = {d: s for d, _, s in rows}
    by = {}
    for r in got.collect():
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(names[r.doc_id], []).append(r)
    total = sum(r["size"] for v in by.values() for r in v)
    order = sorted((s for s in by if s is not None)) + [None]
    goals, open_ = {s: 0.0 for s in order}, set(order)
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    while True:
        left = total - sum(3 * size[s] for s in order if s not in open_)
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]}
        if not over:
            break
        open_ -= over
    for s in order:
        goals[s] = left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * size[s]
        assert abs(by[s][0].target - goals[s]) < 1e-6 and by[s][0].source_size == size[s]
        assert abs(sum(r.taken for r in by[s]) - goals[s]) <= 40, s
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs(spark, rows[::-1]), shard_docs=32).collect()}
    assert again == {(r.doc_id, r.taken) for v in by.values() for r in v}


def test_apportion_by_highest_quotients(spark):
    rng = random.Random(9)
    for seats in (0, 1, 7, 50, 333):
        weights = [rng.choice([0.0, 1.0, 2.5, 17.0, 400.0]) + rng.random() for _ in range(12)]
        df = spark.createDataFrame([(k, w, seats) for k, w in enumerate(weights)], "k int, w double, seats long").coalesce(1)
        got = {r.k: r.got for r in mixing.apportion(df, [], ["k"], "w", "seats", "got").collect()}
        best = sorted(((w / (2 * i + 1), -k) for k, w in enumerate(weights) for i in range(seats)), reverse=True)[:seats]
        assert got == {k: sum(-b == k for _, b in best) for k in range(12)}


def test_taken_rows(spark):
    rows = docs(spark, [(1, " a b\tc d ", "s"), (2, "x y", "s"), (3, "z", "s")])
    plan = spark.createDataFrame([(1, 4, 10), (2, 2, 2), (3, 1, 0)], "doc_id long, size long, taken long")
    got = sorted((r.doc_id, r.text, r.n_chars) for r in mixing.taken_rows(rows, plan).collect())
    assert got == [(1, " a b", 4), (1, " a b\tc d ", 9), (1, " a b\tc d ", 9), (2, "x y", 3)]


# packing


def test_tokens_are_the_tokenizers():
    enc = packing.encoder(packing.default_tokenizer())
    hard = ["it's don't we'll  ''s 's'start  're12½ a²3 x_y é'É can'tve ...'s !'ll", "", "  ", "\xa0a\x85b", "日本 语 text's", "<|endoftext|> a", "a\x1cb", "ß'm ªº µ Ω'S", "I'D'Ve'", "e\u0301a"]
    for text, ids in zip(hard, enc.encode([t.encode() for t in hard])):
        assert ids.tolist() == enc.whole.encode(text, add_special_tokens=False).ids, text


def test_long_texts_and_small_caches(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 500)
    enc = packing.WordEncoder(packing.default_tokenizer(), cached_words=40)
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choice("abcdeé'.1") for _ in range(rng.randint(1, 7))) for _ in range(n)) for n in (3, 700, 1, 90)]
    for text, ids in zip(texts, enc.encode([t.encode() for t in texts])):
        assert ids.tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless(spark):
    rows = [*hard_rows(), (8, "ab " * 3000, "hot")]
    got = packing.pack(packing.pieces(docs(spark, rows), length=256, with_ids=True), length=256, shard_pieces=20).collect()
    enc = packing.encoder(packing.default_tokenizer())
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for d, t, _ in rows:
        ids = [*enc.whole.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [i for r in own[:: 2 if d == 8 else 1] for i in r.ids] == ids
        assert all(r.start == 256 * r.piece for r in own)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256


def test_best_fit_against_a_plain_model():
    rng = np.random.default_rng(8)
    for n in (0, 1, 50, 400):
        sizes = rng.integers(1, 101, n)
        which, offset, bins = packing.best_fit_decreasing(sizes, 100)
        left = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [(room, k) for k, room in enumerate(left) if room >= s]
            if fits:
                left[min(fits)[1]] -= s
            else:
                left.append(100 - s)
        assert bins == len(left) and all(sizes[which == b].sum() <= 100 for b in range(bins))


# language-model scores


def test_scores_against_brute_force(spark):
    rows = hard_rows()
    texts = {d: words_of(t) for d, t, _ in rows}
    n = {k: {} for k in (1, 2, 3)}
    for w in texts.values():
        for k in n:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                n[k][g] = n[k].get(g, 0) + 1
    total = sum(map(len, texts.values()))
    for r in lm_score.score(docs(spark, rows)).collect():
        w, s = texts[r.doc_id], 0.0
        for i in range(len(w)):
            factor = 1.0
            for k in range(min(i + 1, 3), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1 or n[k][g] >= 2:
                    s += np.log(factor * n[k][g] / (n[k - 1][g[:-1]] if k > 1 else total))
                    break
                factor *= 0.4
        assert r.n_words == len(w) and abs(r.log_score - s) < 1e-6 and (r.mean_log_score is None) == (not w)


# quality


def test_classifier_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    x = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in x)
    good, bad = ([r.score for r in x if r.held_out and r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for a in good] for b in bad]) > 0.95
    assert np.mean([s >= 0.5 for s in good]) > 0.95


def test_risk_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (600, 3)), rng.normal(-2, 1, (200, 3))
    web = np.concatenate([rng.normal(1, 1, (600, 3)), bad])
    prior = quality.estimate_prior(good, web)
    assert 0.6 < prior < 0.9
    net = quality.fit(good, web, 0.75, steps=300)
    assert (net.score(good) >= 0.5).mean() > 0.9 and (net.score(bad) < 0.5).mean() > 0.9


def test_classifier_without_positives(spark):
    labels = spark.createDataFrame([(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs(spark, hard_rows()), labels).collect()} == {1.0}
    one = spark.createDataFrame([(3, 1), (4, 1), (5, 1), (6, 1)], "doc_id long, quality int")
    assert quality.classify(docs(spark, hard_rows()), one).count() == len(hard_rows())


# chat


def test_control_strings_survive(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\0", "\\0</s>\\", "<s><s", "", None, "a\n [/INST]\n b", "\\1", "[INST]\\[/INST]", "é" * 5]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "s</s>\n [/INST]\n", None))]
    f = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("p", F.lit(1)))
    r = f.withColumns({"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}).first()
    assert [(t.role, t.text) for t in r.turns] == [(x or "", y or "") for _, _, x, y in rows]
    assert r.loss == "".join(t or "" for t in nasty)
    for s in r.loss_spans:
        assert r.formatted[s.start : s.start + s.length] == r.formatted.split("</s>")[s.turn][s.offset : s.offset + s.length]


def test_turn_order_ties_and_repeats(spark):
    rows = [(1, 1, "b", "x"), (1, 1, "a", "y"), (1, 1, "a", "y"), (1, None, "z", "first"), (None, 0, "u", "null id")]
    got = {r.conv_id: r.turns for r in chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [t.text for t in got[1]] == ["first", "y", "y", "x"] and got[None][0].text == "null id"


def test_layouts(spark):
    rows = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"completion":"y","prompt":"x"}', "prompt", [("user", "x"), ("assistant", "y")]),
        ('{"instruction":"i","input":"k","output":"o"}', "instruction with input", [("user", "i"), ("user", "k"), ("assistant", "o")]),
        ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', "conversations", [("user", "h"), ("assistant", "g")]),
        ('{"question":"q","answer":"w"}', "question", [("user", "q"), ("assistant", "w")]),
        ("nope", None, None), (None, None, None), ("[1]", None, None), ('{"a":{"b c":[1]}}', None, None),
    ]
    got = chat_format.canonical_turns(spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, r string"), "r").orderBy("k").collect()
    for g, (_, name, turns) in zip(got, rows):
        assert g.mapping == name and (None if g.turns is None else [tuple(t) for t in g.turns]) == turns


# urls


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/1?x=1#y", "www.example.com", "/en/1", "www.example.com/en/"), (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"), (3, "x://b.com", "b.com", "", None), (4, "ftp://notcom/", "notcom", "/", None),
            (5, None, "", "", None), (6, "no scheme", "", "", None), (7, "h://net/es/a", "net", "/es/a", "net/es/"), (8, "h://c.net?q/es/", "c.net", "", None), (9, "h://c.com/#x", "c.com", "/", "com/"), (9, "h://c.com/#x", "c.com", "/", "com/"), (10, "h://d.net/fr/" + "a" * 5000, "d.net", "/fr/" + "a" * 5000, "net/fr/")]
    got = url_filter.judge(spark.createDataFrame([(r[0], r[1], 7.0) for r in rows], "page_id long, url string, score double"), trees=3).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "") for r in got) == sorted((r[0], *r[2:4], r[4] or "") for r in rows)
    verdict = {x.text: x.verdict for x in url_filter.RULES}
    assert all(r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdict[r.rule]) for r in got)


def test_url_entropy(spark):
    texts = ["", "a", "aabb", "abcabcd!"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "u string").coalesce(1).select(url_filter.entropy(F.col("u"))).collect()]
    for t, g in zip(texts, got):
        p = [t.count(c) / len(t) for c in set(t)]
        assert abs(g - -sum(x * np.log2(x) for x in p)) < 1e-9


def test_trees_learn_from_given_labels(spark):
    rows = [(k, f"http://{'bet-' * (k % 2)}site{k}.org/p/{k}", k % 2) for k in range(200)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, ok int"), label_col="ok", rules=(), trees=5).collect()
    assert np.mean([(r.verdict == "allow") == bool(r.page_id % 2) for r in got]) > 0.95
