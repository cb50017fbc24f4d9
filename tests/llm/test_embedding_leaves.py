import numpy as np
from pyspark.sql import functions as F

from weftline.llm import embedding_dedup as embedding


def test_leaves_beyond_the_sample_are_split_by_their_own_rows(spark, monkeypatch):
    """Trees of a small sample have few leaves, of some 250 rows; those split on, links stay those of brute force."""
    seen = []
    split = embedding.split_full_leaves

    def measured(routed, *args):
        out = split(routed, *args)
        for df in (routed, out):
            members: dict = {}
            for r in df.where("dim = 32").select("label", "embedding", "leaves").collect():
                for leaf in r["leaves"]:
                    members.setdefault((r["label"], leaf), []).append(r["embedding"])
            seen.append(members)
        return out

    monkeypatch.setattr(embedding, "split_full_leaves", measured)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1800, 32))
    near = base[:600] + rng.normal(size=(600, 32)) * 0.1
    dense = base[11] + rng.normal(size=(150, 32)) * 0.01
    x = np.concatenate([base, near, dense]).astype("float32")
    label = [i % 2 for i in range(1800)] + [i % 2 for i in range(600)] + [1] * 150
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label))] + [(9000, [1.0, 2.0], 0), (9001, [2.0, 4.0], 0), (9002, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.embedding_duplicates(df, leaf=256, sample=400, full=100).collect()}
    before, after = seen
    over = {k for k, v in before.items() if len(v) > 100}
    assert max(map(len, before.values())) > 300 and len(over) > 200
    # what stays large is where the dense cluster lies, all of whose vectors link with each other
    large = [k for k, v in after.items() if len(v) > 100]
    assert len(large) < len(over) / 4 and all(k[0] == 1 for k in large)
    centre = base[11] / np.linalg.norm(base[11])
    for k in large:
        v = np.array(after[k])
        assert (v @ centre / np.linalg.norm(v, axis=1) > 0.99).mean() > 0.3
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    links = linked.sum(1) - 1
    assert links.max() >= 149 and (links > 0).sum() >= 1200
    assert all(got[i][0] <= links[i] for i in range(len(x)))
    assert sum(got[i][0] for i in range(len(x))) >= 0.99 * links.sum()
    assert np.mean([got[i][0] == links[i] for i in range(len(x))]) >= 0.98
    assert got[9000] == (1, 9000) and got[9001] == (1, 9000) and got[9002] == (0, 9002)
