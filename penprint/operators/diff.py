"""What changed between a draft and the text sent."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions import patterns, text

_STRINGS = T.ArrayType(T.StringType())
CHANGES = T.StructType().add("removed", _STRINGS).add("added", _STRINGS).add("changed", T.ArrayType(_STRINGS))


def _paired(old: list[str], new: list[str]) -> tuple[list[str], list[str], list[list[str]]]:
    """Sentences of a replaced stretch: each old one with the free new one it shares most words with."""
    sets, free = [set(s.lower().split()) for s in new], dict.fromkeys(range(len(new)))
    removed, changed = [], []
    for sentence in old:
        mine = set(sentence.lower().split())
        likeness = {j: len(mine & sets[j]) / len(mine | sets[j]) if mine | sets[j] else 0.0 for j in free}
        best = max(likeness, key=likeness.get, default=None)
        if best is not None and likeness[best] > 0 and likeness[best] >= patterns.PAIR_SIMILARITY:
            changed.append([sentence, new[best]])
            del free[best]
        else:
            removed.append(sentence)
    return removed, [new[j] for j in free], changed


def _changes(before: list[str], after: list[str]) -> dict:
    out = {"removed": [], "added": [], "changed": []}
    for _, i, j, k, m in (op for op in difflib.SequenceMatcher(a=before, b=after, autojunk=False).get_opcodes() if op[0] != "equal"):
        for name, part in zip(out, _paired(before[i:j], after[k:m]), strict=True):
            out[name] += part
    return out


@F.pandas_udf(CHANGES)
def sentence_changes(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Sequence alignment has no built-in form: two arrays of sentences in, a struct out, by Arrow batches."""
    return pd.DataFrame([_changes(list(a), list(b)) for a, b in zip(before, after, strict=True)], columns=["removed", "added", "changed"])


def sentence_diff(draft: Column, sent: Column) -> Column:
    """struct(removed, added, changed) of sentences, with what mail programs change taken out of both bodies."""
    each = lambda b: text.sentences(text.for_comparison(F.coalesce(b, F.lit(""))))
    return sentence_changes(each(draft), each(sent))


def structural(pairs: DataFrame) -> DataFrame:
    """pairs (draft_body, sent_body, draft_subject, sent_subject) with counts, forms and the class of the change."""
    a, b = (F.coalesce(f"{x}_body", F.lit("")) for x in ("draft", "sent"))
    n, m = text.n_blank_words(a), text.n_blank_words(b)
    score = text.similarity(a, b)
    out = pairs.withColumns(
        {
            "similarity": score,
            "classification": F.when(score < patterns.REWRITE_SIMILARITY, "rewritten").otherwise("edited"),
            "word_count_delta": m - n,
            "word_count_pct": F.coalesce((m - n) * 100 / F.nullif(n, F.lit(0)), F.lit(0.0)),
            "subject_changed": F.coalesce("draft_subject", F.lit("")) != F.coalesce("sent_subject", F.lit("")),
        }
    )
    for side, x in (("draft", a), ("sent", b)):
        out = out.withColumns(
            {
                f"{side}_sentences": F.size(text.sentences(x)),
                f"{side}_paragraphs": F.size(text.paragraphs(x)),
                f"{side}_opener": text.opener(x),
                f"{side}_signoff": text.signoff(x),
                f"{side}_name_form": text.name_form(x),
            }
        )
    return out
