"""Reading frames: a contig's frames come from its own row, without a shuffle."""

from orfloom.operators.orfs import find_orfs


def test_frames_need_no_shuffle_and_all_letters(spark):
    gene = "AUG" + "GCU" * 60 + "UAA"
    rows = [(1, gene), (2, gene.lower().replace("u", "t")), (3, "ß" + gene), (4, ""), (5, None), (None, gene), (6, "AUG" + "NNN" * 60 + "UAA"), (7, "GUG" + "GCU" * 60 + "UGA" + "GCU" * 60 + "UAG")]
    out = find_orfs(spark.createDataFrame(rows, "contig_id long, seq string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["contig_id"]: (r["orf_id"], r["start"], r["stop"], r["strand"], r["seq"]) for r in out.collect()}
    protein = "M" + "A" * 60
    assert got == {
        1: ("1_ORF_0", 1, 186, 1, protein), 2: ("2_ORF_0", 1, 186, 1, protein), 3: ("3_ORF_0", 3, 188, 1, protein),
        6: ("6_ORF_0", 1, 186, 1, "M" + "X" * 60), 7: ("7_ORF_0", 1, 186, 1, protein),
    }
    # In table 14 UAA is Y and UAG the only stop; UGA is a stop codon still, so no frame runs over it.
    assert {r["contig_id"] for r in find_orfs(spark.createDataFrame(rows, "contig_id long, seq string"), table=14).collect()} == set()
