"""Registration: one query per operator with the contract's columns, and clean removal of the subpackage."""
import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CONTRACT = {
    "op1": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op3": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4": {"page_id", "url", "text", "n_chars"}, "op5": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op6": {"doc_id", "fingerprint", "component_id"}, "op7": {"doc_id", "held_out", "lang_pred", "score"},
    "op10": {"query_id", "rank", "vec_id", "score"}, "op11": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op12": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op13": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_is_registered(spark, n):
    from pitchlens.llm.queries import QUERIES

    names = [q for q in QUERIES if q.startswith(f"op{n}_")]
    assert len(names) == 1
    if f"op{n}" in CONTRACT:
        assert CONTRACT[f"op{n}"] <= set(QUERIES[names[0]](spark, SF).columns)


def test_the_rest_works_without_the_subpackage():
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('pitchlens.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries(); assert 'window_features' in q and not any(x.startswith('op') and x[2].isdigit() for x in q)\n"
            "assert 'pipeline' not in e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
