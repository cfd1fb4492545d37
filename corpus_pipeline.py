"""The corpus pipeline: five operators in a row over documents.

Each stage takes all that its predecessor kept and applies its own decisions:
toxic documents go, one document of each group of near copies stays, documents
with benchmark passages go, sources are mixed to their target weights (a
document may come twice or be cut where a budget ends), and what is left
becomes token ids in ORC files, of which the last stage returns the layout.

Near copies are documents whose sets of five-word shingles have a similarity of
0.8 at least.

Defined cases: each stage takes null and empty texts, null ids, repeated rows,
empty tables and further columns of any name as its operator's docstring says:
none of them is toxic, near or contaminated for lack of words; a text without
words is never taken by the mix, so it ends there; repeated rows of one doc_id
and text leave one row in the near-copies stage; an empty table gives an empty
layout. Columns of documents stay as they are up to the last stage.
"""

from stratalex.llm import decontaminate, jaccard_join, mixing, token_orc, toxicity
from stratalex.llm.textkit import settle, table


def toxicity_stage(spark, docs, sf_dir):
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark, docs, sf_dir):
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark, docs, sf_dir):
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def token_ids_stage(spark, docs, sf_dir):
    return token_orc.save_and_read(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token ids", token_ids_stage),
]

#: SQL can't express the learnt lexicon or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
