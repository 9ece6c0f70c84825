"""Documents of token files come back by select."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import token_files


def test_read_selects_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    documents = [np.arange(n % 7, dtype="<u4").tobytes() for n in range(600)]
    blob = token_files.dump(list(range(600)), documents)
    token_files._put(folder, "good", blob)
    shard = token_files.load(blob)
    wrong = shard.ends.samples + np.uint32(1)
    token_files._put(folder, "bad", blob.replace(shard.ends.samples.tobytes(), wrong.astype("<u4").tobytes()))

    def read(name):
        spark.createDataFrame([(name, 5, 600, len(shard.ids))], "name string, start long, documents long, ids long").write.mode("overwrite").parquet(f"{folder}/manifest")
        return token_files.read(spark, folder)

    rows = read("good").orderBy("doc_id").collect()
    assert [bytes(r["ids"]) for r in rows] == documents
    assert [r["start"] for r in rows] == [5 + sum(len(d) // 4 for d in documents[:i]) for i in range(600)]
    with pytest.raises(Exception, match="select samples are wrong"):
        read("bad").agg(F.sum("n_tokens")).collect()
