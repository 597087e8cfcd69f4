"""S3, S6, S7, S8 readers on small files in a fresh folder."""

import json
import os
import tempfile

from regscope.sources import tables as T


def test_readers(spark):
    d = tempfile.mkdtemp(prefix="regscope-read-")
    open(os.path.join(d, "rank.csv"), "w").write("domain,rank\nexample.com,120\nbit.ly,900\nexample.com,500\n")
    r = {x.domain: x.rank for x in T.read_domain_rank(spark, os.path.join(d, "rank.csv")).collect()}
    assert r == {"example.com": 120, "bit.ly": 900}
    json.dump({"internal-url": ["docker.com"], "short-url": ["bit.ly", "t.co"]}, open(os.path.join(d, "k.json"), "w"))
    k = sorted((x.kind, x.pos, x.value) for x in T.read_keyword_json(spark, os.path.join(d, "k.json")).collect())
    assert k == [("internal-url", 0, "docker.com"), ("short-url", 0, "bit.ly"), ("short-url", 1, "t.co")]
    open(os.path.join(d, "v.vec"), "w").write("2 3\nfoo 0.5 -1 2 \nbar 1e-3 0 0\n")
    v = {x.word: x.vec for x in T.read_word_vectors(spark, os.path.join(d, "v.vec")).collect()}
    assert v["foo"] == [0.5, -1.0, 2.0] and abs(v["bar"][0] - 1e-3) < 1e-9
    open(os.path.join(d, "l.csv"), "w").write("package_id,label\na,1\nb,0\nc,2\n")
    lab = {x.package_id: x.label for x in T.read_labels_csv(spark, os.path.join(d, "l.csv")).collect()}
    assert lab == {"a": "abuse", "b": "non-abuse", "c": "non-abuse"}
