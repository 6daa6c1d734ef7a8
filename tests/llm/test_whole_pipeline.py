"""Each stage of the pipeline by brute force on its own input, against run()'s rows."""

import collections
import hashlib
import math
import re

import corpus_pipeline
from copyledger.llm import toxicity
from copyledger.llm.common import row_key
from llm.test_brute_force import ASCII, SMALL, plain_fingerprint, plain_tiles

COLS = ["doc_id", "text", "lang", "source", "n_chars"]
LINE = "this line of boilerplate stands in many documents"


def plain_lines(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
        return k if len(line) >= 20 and len(k) >= 20 else None
    holders = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(-math.inf if r[0] is None else r[0])
    gone = {k: max(ids) for k, ids in holders.items() if k is not None and len(ids) >= 3}
    out = []
    for r in rows:
        own = -math.inf if r[0] is None else r[0]
        kept = "\n".join(x for x in (r[1] or "").split("\n") if gone.get(key(x), own) == own)
        out.append((r[0], kept, r[2], r[3], len(kept)))
    return out


def plain_components(rows, key):
    fps = [plain_fingerprint(r[1] or "") for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        near = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(rows))]
        if near == label:
            break
        label = near
    kept = {}
    for part in set(label):
        of = [r for r, n in zip(rows, label) if n == part]
        first = min(of, key=lambda r: (r[0] is None, r[0] or 0, key[r[0], r[1]]))
        kept[part] = min(r for r in of if r[:2] == first[:2])
    return list(kept.values())


def plain_clean(rows, items, k=5, coverage=0.5):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    def grams(w):
        return {tuple(w[i:i + k]): i for i in range(len(w) - k + 1)}

    def bad(text, item):
        w, of_item = words(text), grams(item)
        near = {i + x for i in range(len(w) - k + 1) if tuple(w[i:i + k]) in of_item for x in range(k)}
        part = [x if i in near else None for i, x in enumerate(w) if i in near or i - 1 in near]
        return near and sum(t[2] for t in plain_tiles(part, item, k)) >= coverage * len(item)
    items = [words(t) for t in items]
    return [r for r in rows if not any(bad(r[1], i) for i in items if len(i) >= k)]


def plain_mix(rows):
    sized = []
    for d, text, _, source, _ in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        seed = ":".join(x for x in ("7", None if d is None else str(d), text) if x is not None)
        u = (int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        w = 1 / (1 + abs(len(text or "") / max(size, 1) - 6) / 6)
        sized.append((source, -math.log(u) / w, d is not None, d or 0, size, d))
    total = collections.Counter()
    for s in sized:
        total[s[0]] += s[4]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, free, target = 1.5 * sum(total.values()), set(names), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if 2 * total[s] <= level * weight[s]}
        for s in full or free:
            target[s] = 2 * total[s] if full else level * weight[s]
        budget -= sum(target[s] for s in full)
        free = free - full if full else set()
    out = collections.Counter()
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        before = 0
        for _, _, _, _, size, d in sorted(x for x in sized if x[0] == s) if s is not None else sorted(
                (x for x in sized if x[0] is None), key=lambda x: x[1:5]):
            extra = before + size / 2 <= target[s] - epochs * total[s]
            out[d, s, size, size * min(2, epochs + extra)] += 1
            before += size
    return out


def test_every_stage_of_run_by_brute_force(spark, tmp_path, monkeypatch):
    small = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*COLS).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").limit(20).collect()]
    top = max(r[0] for r in small)
    texts = [(top + 1 + i, f"{LINE}\n{t[1]}\n {LINE.upper()}") for i, t in enumerate(small[:6])]
    texts += [(top + 20 + i, f"word number {i} before {t} after") for i, t in enumerate(items[:5])]
    texts += [(top + 30, small[9][1]), (top + 30, small[9][1]), (None, f"{LINE}\nwithout an id"), (None, None),
              (top + 31, ""), (top + 32, "the same id"), (top + 32, "another text under the same id")]
    rows = small + [(d, t, "en", (None, "x")[i % 2], None if t is None else len(t)) for i, (d, t) in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    staged = {}
    real = corpus_pipeline.stage
    monkeypatch.setattr(corpus_pipeline, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    out = corpus_pipeline.run(spark, str(tmp_path))
    names = [f"pipeline-{n}" for n, _ in corpus_pipeline.STAGES]
    assert list(staged) == names

    def of(name):
        return [tuple(r) for r in staged[name].select(*COLS).collect()]
    tox, lines, near, clean = (of(n) for n in names[:4])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = {(r["doc_id"], r["key"]): r["score"] for r in toxicity.score_texts(docs, labels).collect()}
    keyed = [tuple(r) for r in docs.select(*COLS, row_key()).collect()]
    count = collections.Counter
    assert count(tox) == count(r[:5] for r in keyed if score[r[0], r[5]] < 0.7) and len(tox) < len(rows)
    assert count(lines) == count(plain_lines(tox)) and lines != tox
    key = {(r[0], r[1]): r[2] for r in staged[names[1]].select("doc_id", "text", row_key()).collect()}
    assert count(near) == count(plain_components(lines, key)) and len(near) < len(lines)
    assert count(clean) == count(plain_clean(near, items)) and len(clean) < len(near)
    got = count((r["doc_id"], r["source"], r["size"], r["taken"]) for r in out.collect())
    assert got == plain_mix(clean)
