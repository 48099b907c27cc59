"""The pipeline, stage by stage, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_pairs import plain_components

import corpus_pipeline
from fenestra.llm.common import cut

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(240):
        w = [r.choice(words) for _ in range(r.randint(30, 50))]
        if i % 6 == 0:
            w[3:3] = ["wretched", "scoundrel"]
        if i % 5 == 0:
            w += ["joe.1@mail2.example.com", "+1 (855) 555-4208", "now", "10.20.30.40"]
        rows.append((i, " ".join(w), "en", f"s{r.choice([0, 0, 0, 1, 1, 2])}", len(" ".join(w))))
    rows += [(300 + i, rows[i][1] + " more", "en", "s1", len(rows[i][1]) + 5) for i in range(1, 60, 4)]
    toxic = {i for i, t, *_ in rows if "wretched" in t}
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, *_ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {}

    def noted(name, stage):
        def run(*args):
            out[name] = cut(stage(*args))
            return out[name]

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in corpus_pipeline.STAGES])
    corpus_pipeline.run(spark, str(tmp_path))
    assert list(out) == ["toxicity", "near_duplicates", "personal_data", "mixing", "bpe"]
    assert all(out[s].columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in list(out)[:-1])
    got = {s: [tuple(x) for x in out[s].collect()] for s in list(out)[:-1]}
    want = [x for x in rows if x[0] not in toxic]
    assert sorted(got["toxicity"]) == sorted(want)
    of = plain_components([x[:2] for x in want])
    assert len({c for _, c in of.values()}) < len(want)
    want = [x for x in want if of[x[0]][1] == x[0]]
    assert sorted(got["near_duplicates"]) == sorted(want)
    clean = lambda t: re.sub(r"\S+@\S+ \+1 \(855\) 555-4208 now 10\.20\.30\.40", "<EMAIL> <PHONE> now <IP>", t)
    want = [(i, clean(t), a, s, len(clean(t))) for i, t, a, s, _ in want]
    assert any("<PHONE>" in x[1] for x in want) and sorted(got["personal_data"]) == sorted(want)
    # repetitions are whole or, once a source at most, a run of the words; sources keep to 5 : 2 : 1 where three repetitions suffice
    by, size, taken = {x[0]: x for x in want}, defaultdict(int), defaultdict(int)
    for x in want:
        size[x[3]] += len(x[1].split())
    for i, t, a, s, _ in got["mixing"]:
        w = t.split()
        assert f" {t} " in f" {by[i][1]} " and (a, s) == by[i][2:4]
        taken[s] += len(w)
    assert all(n <= 1 for n in Counter(x[3] for x in got["mixing"] if x[1] != by[x[0]][1]).values())
    assert abs(sum(taken.values()) - sum(size.values())) <= 3 and all(taken[s] <= 3 * size[s] for s in size)
    free = [taken[s] / k for s, k in zip(sorted(size), (5, 2, 1)) if taken[s] < 3 * size[s] - 1]
    assert max(free) - min(free) <= 2
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    plain = Counter((x[0], hashlib.sha256(np.array(t.encode(x[1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for x in got["mixing"])
    assert Counter((x.doc_id, x.ids_sha256) for x in out["bpe"].collect()) == plain


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "a b c " * 400, None, "s", 2400), (4, "a b c " * 400, "en", None, 2400)]])
def test_pipeline_of_odd_rows(spark, tmp_path, rows):
    """An empty table gives no rows; nulls, empty and repeated rows don't stop a stage, and of equal texts one document is left."""
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got if x.n_tokens} <= {None, 3} and (bool(got) or not rows)
