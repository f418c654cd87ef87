"""Token counts, secrets, mixing, chat formatting, top-k and language ID against brute force and by hand."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from framewright.llm import chat_format, language_id, mixing, queries, secret_scan, token_counts, topk

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ token counts


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_odd_texts(sp):
    rng = random.Random(1)
    have = token_counts.Counter(MODEL)
    odd = ["", " ", "\n", "  ", " \n ", "▁", "a▁ b", "▁ ▁", "<s> </s> <unk> <0x0A>", "\x00", "é́ 漢字 🙂‍", "a\r\n\tb", "\n\n\n x", "x" * 5000]
    odd += ["".join(rng.choice("ab  \n▁\té漢the ing<>s/") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert [have.count(t) for t in odd] == [len(x) for x in sp.encode(odd)]


def test_token_counts_bounded_memo(sp, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 5)
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 6)
    have = token_counts.Counter(MODEL)
    texts = ["zqx wvutsrq zqx", "bleshould qqqqqqqqqqqq qqqqqqqqqqqq", "a b c d e f g h qa qb qc qd qe qf"]
    assert [have.count(t) for t in texts] == [len(x) for x in sp.encode(texts)]
    assert len(have.memo) <= len(have.whole) + 5


def test_token_counts_whole_table(spark, sp, documents):
    got = {r["doc_id"]: r for r in queries.op1_token_counts(spark, SF).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        t = r["text"] or ""
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)


def test_token_counts_edges(docs_of):
    rows = token_counts.token_counts(docs_of([(1, None), (None, "a b"), (2, ""), (2, "")]).withColumn("n_tokens", F.lit("x")), MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 2), (1, 0), (2, 0), (2, 0)]
    assert token_counts.token_counts(docs_of([]), MODEL).count() == 0


# ------------------------------------------------------------------ secrets


def spans_by_hand(t):
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_secrets_whole_table(spark, documents):
    got = {r["doc_id"]: r for r in queries.op2_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    n = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        want, g = spans_by_hand(r["text"] or ""), got[r["doc_id"]]
        c = Counter(x[3] for x in want)
        n += len(want)
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == (c["assign"], c["access"], c["hex"])
        assert g["base_sha256"] == hashlib.sha256(said(want).encode()).hexdigest()
        assert set(said(want).split(",")) <= set(g["spans"].split(","))
    assert n > 10


def test_secrets_odd_texts(docs_of):
    rng = random.Random(2)
    bits = ["password", "Token", "api_key", "APIKEY", ":", "=", " ", "'", '"', "abcdef123", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef" * 2, "é🙂", "\n", "secret=", "abc"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)] + [None, ""]
    found = secret_scan.secret_scan(docs_of(list(enumerate(texts)))).collect()
    for r in found:
        base = [s for s in r["spans"] if s["kind"] != "opaque"]
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base) == said(spans_by_hand(texts[r["doc_id"]] or ""))


def test_secrets_ownership(docs_of):
    live, copied = "Zx9" + "qW7rT2yU4iO6pA8s" * 2, "Ab1" + "cD2eF3gH4iJ5kL6m" * 2
    rows = [(1, f"key {live}.", "en", "a"), (2, f"key {copied}", "en", "a"), (3, f"key {copied}", "en", None), (6, f"key {copied}", "en", "b"), (4, f"password={live}", "en", "a"), (4, f"password={live}", "en", "a"), (5, "clean", None, None)]
    docs = docs_of(rows)
    scanned = secret_scan.secret_scan(docs)
    got = defaultdict(list)
    for r in scanned.collect():
        got[r["doc_id"]].append([(s["kind"], s["n_owners"], s["live"]) for s in r["spans"]])
    assert got[1] == [[("opaque", 1, True)]] and got[2] == [[]] and got[5] == [[]]
    assert len(got[4]) == 2 and ("assign", 1, True) in got[4][0]
    out = {r["doc_id"]: r for r in secret_scan.redacted(docs, scanned).collect()}
    assert live not in out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"]) and copied in out[3]["text"] and out[5]["text"] == "clean"
    assert out[4]["text"] == "[secret]"
    assert secret_scan.secret_scan(docs_of([])).count() == 0


def test_secrets_many_spans_of_one_text(docs_of):
    """Each span is placed by a running sum, so twice the spans take about twice the time, not four times."""
    import time

    took = {}
    for n in (500, 16_000, 32_000):  # the first one compiles
        docs = docs_of([(1, "token=abcdefgh1234 é " * n)])
        began = time.time()
        scanned = secret_scan.secret_scan(docs)
        (row,) = scanned.collect()
        took[n] = time.time() - began
        assert len(row["spans"]) == n and all(s["start"] == 21 * i and s["end"] == 21 * i + 18 for i, s in enumerate(row["spans"]))
        assert secret_scan.redacted(docs, scanned).first()["text"] == "[secret] é " * n
    assert took[32_000] < 2.5 * took[16_000] + 3


def test_secrets_redacted_runs(docs_of):
    """Overlapping live spans are one run; what is between runs stays, at the edges too."""
    key, rng = "AKIA" + "QWERTYUIOP012345", random.Random(21)
    docs = docs_of([(i, "".join(rng.choice([key, f"secret={key}", "é", " ", "\n", f"token: {key}-x", "word"]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(None, key), (99, key)])
    scanned = secret_scan.secret_scan(docs, max_owners=9, max_repos=999)
    out = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs, scanned).collect()}
    text, n = {r["doc_id"]: r["text"] for r in docs.collect()}, 0
    for r in scanned.collect():
        runs = []
        for a, b in sorted((s["start"], s["end"]) for s in r["spans"] if s["live"]):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        t, at, want = text[r["doc_id"]], 0, ""
        for a, b in runs:
            want, at = want + t[at:a] + "[secret]", b
        assert out[r["doc_id"]] == want + t[at:]
        n += len(runs)
    assert n > 50


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_secrets_hot_values(spark, most):
    """Values of very many rows don't meet by hash; the counts are the same."""
    rows = [(f"h{i % 9 if i % 2 else 0}", i % 31, "abc"[i % 3] if i % 5 else None) for i in range(200)]
    got = secret_scan.judged(spark.createDataFrame(rows, "hash string, repo long, owner string"), most).collect()
    repos, owners = defaultdict(set), defaultdict(set)
    for h, r, o in rows:
        repos[h].add(r)
        owners[h].add(o)
    assert len(got) == 200 and all((g["n_repos"], g["n_owners"]) == (len(repos[g["hash"]]), len(owners[g["hash"]])) for g in got)


# ------------------------------------------------------------------ mixing


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full, out = 1.5 * sum(sizes.values()), {}, {}
    while True:
        rest, w = total - sum(full.values()), sum(weight[s] for s in order if s not in full)
        out = {s: full.get(s, rest * weight[s] / w if w else 0) for s in order}
        if not (new := {s: 2 * sizes[s] for s in order if s not in full and out[s] > 2 * sizes[s]}):
            return out
        full |= new


def test_mixing_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_mixing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    docs["n"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text]
    m = docs.merge(got, on="doc_id")
    assert (m["n"] == m["size"]).all() and len(m) == len(docs) and (m.taken <= 2 * m["size"]).all()
    want = targets_by_hand(docs.groupby("source").n.sum().to_dict())
    for s, part in m.groupby("source"):
        assert part.source_size.iloc[0] == part["size"].sum()
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert abs(part.taken.sum() - want[s]) <= part["size"].max() / 2 + 1
    again = queries.op5_mixing(spark, sf).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mixing_edges(docs_of):
    rows = [(1, "a b c", "en", None), (2, None, "en", "x"), (3, "", "en", "x"), (None, "d", "en", "é"), (4, "e f", "en", "y"), (4, "e f", "en", "y")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == 6 and all(r["taken"] <= 2 * r["size"] for r in got)
    want = targets_by_hand({None: 3, "x": 0, "é": 1, "y": 4})
    assert {round(r["target"], 6) for r in got} == {round(v, 6) for v in want.values()}
    assert mixing.mix(docs_of([])).count() == 0


@pytest.mark.parametrize("n", [2, 4, 10])
def test_mixing_bins_meet_the_rest(docs_of, n):
    """Bins of equal documents add up to the rest exactly: the source still gets 1.5 copies, not 2."""
    got = mixing.mix(docs_of([(i, "w " * 10, "en", "a") for i in range(n)])).collect()
    assert sum(r["taken"] for r in got) == 15 * n and sorted(r["copies"] for r in got) == [1] * (n // 2) + [2] * (n // 2)


def chances_by_hand(sizes, rest):
    """Inclusion probability by document: proportional to size, those that reach one certain, until none is above."""
    certain = set()
    while True:
        left, squares = rest - sum(sizes[i] for i in certain), sum(s * s for i, s in enumerate(sizes) if i not in certain)
        p = [1.0 if i in certain else left * s / squares if squares else 0.0 for i, s in enumerate(sizes)]
        if not (new := {i for i, x in enumerate(p) if i not in certain and x >= 1}):
            return p
        certain |= new


def test_mixing_inclusion_follows_the_probabilities(docs_of):
    """Certain documents are always in; the others as often as their size says; their expected words are the rest."""
    rng = random.Random(15)
    size = [rng.choice([1, 2, 3, 5, 9, 400]) if i % 40 else 900 for i in range(240)]
    docs = docs_of([(i, "w " * n, "en", "ab"[i % 2]) for i, n in enumerate(size)])
    extra, runs = np.zeros(240), 24
    for seed in range(runs):
        got = {r["doc_id"]: r for r in mixing.mix(docs, weights=(4, 1), seed=seed).collect()}
        for i in range(240):
            extra[i] += got[i]["copies"] - int(got[i]["target"] / got[i]["source_size"] + 1e-12)
    for s in (0, 1):
        ids = list(range(s, 240, 2))
        r = got[s]
        rest = r["target"] % r["source_size"] if r["target"] < 2 * r["source_size"] else 0.0
        want = chances_by_hand([size[i] for i in ids], rest)
        assert [got[i]["p"] for i in ids] == pytest.approx(want) and sum(p * size[i] for p, i in zip(want, ids)) == pytest.approx(rest)
        for n in set(size):
            of = [(extra[i], p) for p, i in zip(want, ids) if size[i] == n]
            if of:
                share, p = sum(x for x, _ in of) / runs / len(of), of[0][1]
                assert share == p if p in (0, 1) else abs(share - p) < 4.5 * (p * (1 - p) / runs / len(of)) ** 0.5 + 0.03


@pytest.mark.parametrize("bins", [1, 8, 1 << 14])
def test_mixing_takes_the_documents_that_a_plain_run_takes(spark, docs_of, bins):
    """The same order and cut in Python, over whole sources, ties and repeated rows among them."""
    rng = random.Random(16)
    rows = [(rng.choice([None, *range(90)]), " ".join("w" * rng.choice([0, 1, 1, 4, 7, 60])) or None, "en", rng.choice([None, "x", "y", "é"])) for _ in range(300)]
    docs = docs_of(rows)
    u = {(r["doc_id"], r["text"]): r["u"] for r in docs.select("doc_id", "text", mixing._uniform(F.xxhash64(F.lit(5), F.col("doc_id"), F.coalesce("text", F.lit("")))).alias("u")).collect()}
    by = defaultdict(list)
    for d, t, _, s in rows:
        by[s].append((d, len(re.findall(r"\S+", t or "")), u[d, t]))
    targets = targets_by_hand({s: sum(x[1] for x in v) for s, v in by.items()})
    want = []
    for s, v in by.items():
        total = sum(x[1] for x in v)
        whole = min(2, int(targets[s] / total + 1e-12))
        rest = max(0.0, targets[s] - whole * total)
        chance = chances_by_hand([x[1] for x in v], rest)
        rank = lambda p, x: 0.0 if p >= 1 else 1.0 if p <= 0 else (o := x / (1 - x) / (p / (1 - p))) / (1 + o)
        at = 0
        for q, d, n in sorted(((rank(p, x), -1 if d is None else d, n) for p, (d, n, x) in zip(chance, v))):
            extra = rest > 0 and at + n / 2 <= rest
            at += n
            want.append((None if d < 0 else d, n, (whole + extra) * n))
    got = [(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs, bins=bins).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# ------------------------------------------------------------------ chat formatting


def chats_by_hand(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        masked = "".join(x[2] for x in turns if x[1] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest())
    return out


def as_tuples(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_chat_whole_table(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_tuples(queries.op8_chat_format(spark, SF)) == chats_by_hand([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_chat_control_strings_and_edges(spark):
    rng = random.Random(3)
    bits = ["<|turn|>", "<|end|>", "\n", "<", "\\", "|end|>", "</s>", "[INST]", "[\\INST]", "é🙂", "n", "assistant\n", "<\\|end|>\n", "role"]
    word = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(7)))
    rows = [(c, rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", None, word()]), rng.choice([None, word(), word()])) for c in [None, *range(40)] for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    chats = chat_format.chat_format(df)
    assert as_tuples(chat_format.digests(chats)) == chats_by_hand(rows)
    one = chat_format.chat_format(spark.createDataFrame([(1, 0, "user", "a<|end|>b</s>")], "conv_id long, turn long, role string, text string")).first()
    assert one["formatted"] == "<|turn|>user\na<\\|end|>b<\\/s><|end|>\n" and one["loss"] == []
    assert chat_format.chat_format(df.limit(0)).count() == 0


def test_chat_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t} é") for c, n in ((1, 40), (2, 3), (None, 9)) for t in range(n)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert as_tuples(chat_format.digests(chat_format.chat_format(df))) == chats_by_hand(rows)
        assert as_tuples(chat_format.digests(chat_format.chat_format(df.unionByName(df.withColumn("conv_id", F.col("conv_id") + 10)), most=50))) == chats_by_hand(rows + [(None if c is None else c + 10, *x) for c, *x in rows])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ------------------------------------------------------------------ top-k


def top_by_hand(rows, k, every):
    v = [(i, [int(np.floor(64 * float(c))) for c in x]) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    out = set()
    for q, a in v:
        if q % every == 0:
            best = sorted((-sum(s * t for s, t in zip(a, b)), i) for i, b in v if i != q and len(b) == len(a))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


def test_top_k_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op9_top_k(spark, SF)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == top_by_hand(rows, 20, 20)


def test_top_k_small_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in range(90)] + [(100, None), (104, [1.0, None, 0.0, 0.0, 0.0]), (108, [float("nan")] * 5), (112, [float("inf")] * 5), (116, [0.25] * 5), (120, [1e6] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {tuple(r) for r in topk.top_k(df, k=3, every=4, nodes=2, rows=10, queries=5).collect()}
    assert got == top_by_hand(rows, 3, 4)
    odd = rows + [(200 + i, [float(i % 3), 0.5]) for i in range(12)] + [(300, [2.0]), (304, [-1.0]), (304, [3.0]), (308, [])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    for nodes in (1, 3):
        got = {tuple(r) for r in topk.top_k(df.filter("vec_id != 304"), k=3, every=4, nodes=nodes, rows=10, queries=5).collect()}
        assert got == top_by_hand([x for x in odd if x[0] != 304], 3, 4)
    assert {r["vec_id"] for r in topk.top_k(df, k=3, every=300, rows=10).filter("query_id = 300").collect()} == {304}
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(few, k=20, every=1).collect()} == top_by_hand(rows[:3], 20, 1)
    assert topk.top_k(few.limit(0)).count() == 0


def test_top_k_scores_only_what_is_handed_in(spark):
    """The nodes hand in a small part of their local scores, and only these pairs get a score."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    counted = []
    got = {tuple(r) for r in topk.top_k(df, k=5, every=50, rows=700, counted=counted).collect()}
    assert got == top_by_hand([(i, v.tolist()) for i, v in enumerate(x)], 5, 50)
    assert 60 * 5 <= counted[0].agg(F.sum("n")).first()[0] < 0.15 * 60 * 3000
    assert counted[0].select("node").distinct().count() == topk.NODES


# ------------------------------------------------------------------ language ID


def test_language_id_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_language_features_and_votes_by_hand():
    """Each byte run counts, of long texts too; the family is chosen first, then every pair of its languages votes."""

    def by_hand(text, dim):
        b, counts = f" {text.lower()} ".encode(), [0] * dim
        for k, salt in ((1, 2654435761), (2, 2246822519), (3, 3266489917)):
            for i in range(len(b) - k + 1):
                x = int.from_bytes(b[i : i + k], "big")
                counts[((x + (salt & 255)) * salt % 2**32) >> (33 - dim.bit_length())] += 1
        out = np.sqrt(counts)
        return out / np.linalg.norm(out)

    for text in ("a", "Ünïcode 漢字 🙂", "x y " * 270_000):
        assert np.allclose(language_id.features(text, 256), by_hand(text, 256), atol=1e-6)
    rng = np.random.default_rng(18)
    langs = ["en", "de", "nl", "fr", "es", "fi", "ja"]
    x = np.abs(rng.normal(size=(140, 32))).astype(np.float32) + np.repeat(np.eye(7, 32, dtype=np.float32) * 2, 20, axis=0)
    model = language_id.Model(x, [g for g in langs for _ in range(20)])
    assert set(model.families) == {"germanic", "romance", "uralic", "lang:ja"} and len(model.pairs["germanic"]) == 3
    sig = lambda m: 1 / (1 + np.exp(-2 * m))
    got, score = model.predict(x)
    for v, g, s in zip(x, got, score):
        tops = sorted(((float(w[:-1] @ v + w[-1]), f) for w, f in zip(model.top, model.families)), reverse=True)
        votes, sums = Counter(), Counter()
        for a, b, w in model.pairs[tops[0][1]]:
            m = float(w[:-1] @ v + w[-1])
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
        want = max(model.members[tops[0][1]], key=lambda x: (votes[x], sums[x]))
        near = [m if a == want else -m for a, b, w in model.pairs[tops[0][1]] if want in (a, b) for m in [float(w[:-1] @ v + w[-1])]]
        assert g == want and s == pytest.approx(sig(tops[0][0] - tops[1][0]) * (sig(2 * min(near)) if near else 1), abs=1e-4)


def test_language_id_edges(docs_of, documents):
    import zlib

    docs = docs_of([(1, None), (2, "123 !"), (3, "", None), (None, "the of and")])
    got = language_id.language_id(documents.unionByName(docs).withColumn("score", F.lit("x")))
    und = [r for r in got.collect() if r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in und} >= {1, 2, 3} and all(r["score"] == 0 for r in und)
    rows = language_id.language_id(documents).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert language_id.language_id(docs_of([])).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(docs_of([(1, "words", None)])).collect()} == {"und"}


# ------------------------------------------------------------------ every query that SQL can express


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    plain = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_language_many_labels(docs_of):
    """No label is dropped where there are more than a bounded sample has room for."""
    docs = docs_of([(i, f"words of number {i}", f"l{i % 7}") for i in range(140)])
    assert language_id.train(docs, max_rows=16).langs == [f"l{i}" for i in range(7)]
