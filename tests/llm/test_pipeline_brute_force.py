"""The corpus pipeline against a plain version of its five stages, over the whole of a small table."""

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as CP
from cinnabar.llm import language_id as L
from cinnabar.llm import mixing as MX
from cinnabar.llm import near_dedup as ND
from cinnabar.llm import packing as PK
from cinnabar.llm.simhash import simhashes
from cinnabar.llm.textkern import span_hashes

SF = "/root/testdata/sf0.001"


def bundle(text, known):
    x = [0]
    for c in [*(ord(c.lower()[0]) if unicodedata.category(c)[0] in "LM" else 0 for c in unicodedata.normalize("NFC", text)), 0]:
        if c or x[-1]:
            x.append(c)
    grams = Counter(zip(x, x[1:], x[2:], strict=False)) if len(x) > 2 else {}
    total = np.zeros(L.DIM)
    for gram, n in grams.items():
        if gram not in known:
            a, b, c = (L.letter_vectors(np.array([k]))[0].astype(float) for k in gram)
            known[gram] = np.roll(a, 2) * np.roll(b, 1) * c
        total += n * known[gram]
    return total, sum(grams.values())


def languages(rows):
    known, sums, made = {}, {}, []
    for r in rows:
        v, n = bundle(r["text"] or "", known)
        size = np.linalg.norm(v)
        made.append((v, n, size))
        if size and r["lang"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + np.rint((v / size).astype(np.float32) * 4096).astype(np.int64)
    names = sorted(sums)
    prototypes = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    out = []
    for r, (v, n, size) in zip(rows, made, strict=True):
        if not size:
            continue
        cos = prototypes @ v / size
        best = int(np.argmax(cos))
        if cos[best] >= 0.1 or n < 12:
            out.append(r | {"lang": r["lang"] if n < 12 and r["lang"] is not None else names[best]})
    return out


def lines(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        each = r["text"].split("\n")
        full = [(k, x.strip(" \t\r")) for k, x in enumerate(each) if x.strip(" \t\r")]
        gone = set()
        for j in range(len(full) - 2):
            key = tuple(x for _, x in full[j : j + 3])
            gone |= {k for k, _ in full[j : j + 3]} if key in seen else set()
            seen.add(key)
        text = "\n".join(x for k, x in enumerate(each) if k not in gone)
        if not gone or text.strip(" \t\r\n"):
            text = text if gone else r["text"]
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def without_copies(rows):
    codes = simhashes(pa.array([r["text"] for r in rows]))[0]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if codes[i].any() and codes[j].any() and int(np.bitwise_count(codes[i] ^ codes[j]).sum()) <= ND.RADIUS:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [r for k, r in enumerate(rows) if top(k) == k]


def mixed(rows, model, draws):
    p, tokens = [], []
    for at, slots, shape, n in MX.features(pa.array([r["text"] for r in rows])):
        p.append(np.round(model.posterior(at, slots, shape), 9))
        tokens.append(n)
    p, tokens = np.concatenate(p), np.concatenate(tokens).astype(float)
    weight = np.array([MX.TARGETS[d] for d in MX.DOMAINS])
    goal = weight * (tokens @ p)[MX.DOMAINS.index(MX.WHOLE)] / weight[MX.DOMAINS.index(MX.WHOLE)]
    r = np.ones(len(rows))
    for _ in range(40):
        reached = (r * tokens) @ p
        miss = np.abs(reached - goal).sum()
        if miss <= 1e-6 * goal.sum():
            break
        free = r > 0
        step = np.linalg.pinv(p[free].T @ (p[free] * tokens[free, None]), rcond=1e-6) @ (reached - goal)
        for k in range(6):
            after = np.maximum(0, r - p @ step / 2**k)
            if np.abs((after * tokens) @ p - goal).sum() < miss:
                break
        if miss - np.abs((after * tokens) @ p - goal).sum() <= 1e-9 * goal.sum():
            break
        r = after
    return [row for row, rate in zip(rows, r, strict=True) for _ in range(int(np.floor(round(rate, 9) + draws[row["doc_id"]])))]


def windows(rows, window):
    def slots(ws):
        raw = b"\n".join(ws)
        ends = np.cumsum([len(w) + 1 for w in ws]) - 1
        return Counter((span_hashes(np.frombuffer(raw, np.uint8), ends - [len(w) for w in ws], ends) >> np.uint64(64 - PK.TERM_BITS)).astype(int).tolist())

    words = [r["text"].encode().split() for r in rows]
    n = sum(bool(w) for w in words)
    mean = sum(map(len, words)) / max(1, n)
    df = Counter(t for w in words if w for t in slots(w))
    idf = {t: np.log1p((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    out = [[rows[k]["doc_id"]] for k, w in enumerate(words) for _ in range(len(w) // window)]
    tail = {k: w[len(w) // window * window :] for k, w in enumerate(words) if len(w) % window}
    bags = {k: slots(w) for k, w in tail.items()}
    free = dict.fromkeys(sorted(tail, key=lambda k: (-len(tail[k]), rows[k]["doc_id"])))
    rank = {k: i for i, k in enumerate(free)}
    while free:
        seed = next(iter(free))
        del free[seed]
        score = {i: sum(idf[t] * bags[i][t] * 2.2 / (bags[i][t] + 1.2 * (0.25 + 0.75 * len(tail[i]) / mean)) for t in bags[seed] if t in bags[i]) for i in free}
        members, left = [seed], window - len(tail[seed])
        for i in sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], rank[i])):
            if len(tail[i]) <= left:
                members.append(i)
                left -= len(tail[i])
                del free[i]
        out.append([rows[k]["doc_id"] for k in members])
    return out


def test_pipeline_by_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in d.orderBy("doc_id").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["n_chars"])
    for k, plain in enumerate((languages, lines, without_copies)):
        d = MX.materialize(CP.STAGES[k][1](spark, d, SF), "t")
        rows = plain(rows)
        assert sorted(map(key, rows)) == sorted(key(r.asDict()) for r in d.collect()), CP.STAGES[k][0]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(2)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    draws = {r["doc_id"]: r["u"] for r in d.select("doc_id", u.alias("u")).collect()}
    rows = mixed(rows, MX.fit_classifier(d, labels), draws)
    d = MX.materialize(CP.STAGES[3][1](spark, d, SF), "t")
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in d.collect())
    want = Counter(tuple(sorted(w)) for w in windows(rows, PK.WINDOW))
    got = Counter(tuple(sorted(r["doc_ids"])) for r in CP.run(spark, SF).collect())
    assert sum((want & got).values()) >= 0.9 * sum(want.values())  # weights in whole steps may order near ties otherwise
    assert Counter(i for w in got.elements() for i in w) == Counter(i for w in want.elements() for i in w)
