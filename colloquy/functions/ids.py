"""Session, subset and channel out of recording names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The subsets of the corpus.
SUBSETS = ["0S", "0L", "OV10", "OV20", "OV30", "OV40"]
#: What the folders' ratio and silences stand for, and the form of the codes.
DETAILS = {
    "0.0_sil2.9_3.0": "0L",
    "0.0_sil0.1_0.5": "0S",
    "10.0_sil0.1_1.0": "OV10",
    "20.0_sil0.1_1.0": "OV20",
    "30.0_sil0.1_1.0": "OV30",
    "40.0_sil0.1_1.0": "OV40",
}
CODES = r"OV\d0|0[LS]"


def first_match(*found: Column) -> Column:
    """The first of some extractions that isn't empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def subset(name: Column) -> Column:
    """0S, 0L or OVxx of a session's name; null for a name of no known form.

    Without overlap, a silence of 2.9 to 3.0 s is the long one.
    """
    ratio = F.regexp_extract(name, r"overlap_ratio_(\d+)\.\d+_sil(\d+\.\d+)_", 1)
    silence = F.regexp_extract(name, r"overlap_ratio_(\d+)\.\d+_sil(\d+\.\d+)_", 2)
    long_form = F.when(ratio == "", None).when(ratio != "0", F.concat(F.lit("OV"), ratio)).when(silence.cast("double") >= 1, "0L").otherwise("0S")
    found = F.coalesce(long_form, first_match(F.regexp_extract(name, r"(?:^|_)(OV\d+|0S|0L)(?:_|$)", 1)))
    return F.when(found.isin(SUBSETS), found)


def split_of(name: Column) -> Column:
    """dev for the sessions whose name has ``session0``, eval for the others."""
    return F.when(name.contains("session0"), "dev").otherwise("eval")


def session_of(name: Column) -> Column:
    """``session`` with its number."""
    return first_match(F.regexp_extract(name, r"(session[^_]*)(?:_|$)", 1))


def details_subset(details: Column) -> Column:
    """The subset that a folder's ratio and silence stand for; null for any not in the table."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair]), details)


def canonical(name: Column, utterance: bool = False) -> Column:
    """``sessionN_CH0_SUBSET`` of a recording's name in one of four forms; null for any other name.

    utterance: the names of utterances instead, with a speaker's number before the recording and,
    but for folders, two places after it. A name has to match as a whole.
    """
    before, after = (r"\d+_", r"_\d+_\d+") if utterance else ("", "")
    folder = rf"\A{before}overlap_ratio_(.*)_session(.*)_actual.*\z"
    coded = rf"\A{before}session(\d+)(?:_CH0)?_({CODES}){after}\z"
    turned = rf"\A({CODES})_session(\d+)\z"
    found = [
        (F.regexp_extract(name, folder, 2), details_subset(F.regexp_extract(name, folder, 1)), name.rlike(folder)),
        (F.regexp_extract(name, coded, 1), F.regexp_extract(name, coded, 2), name.rlike(coded)),
    ]
    if not utterance:
        found.append((F.regexp_extract(name, turned, 2), F.regexp_extract(name, turned, 1), name.rlike(turned)))
    return F.coalesce(*[F.when(known, F.concat(F.lit("session"), session, F.lit("_CH0_"), kind)) for session, kind, known in found])


def short(name: Column, utterance: bool = False) -> Column:
    """``sessionN_SUBSET`` of a name that canonical() knows."""
    return F.replace(canonical(name, utterance), F.lit("_CH0"), F.lit(""))


def canonical_by_prefix(name: Column) -> Column:
    """The older reading: a folder's name or a name with any channel, each with anything after it.

    A folder's name becomes canonical, a name with a channel stays as it is; null for others.
    """
    folder = r"\Aoverlap_ratio_(.*)_session(.*)_actual"
    coded = rf"\Asession.*_CH.*_(?:{CODES})"
    made = F.concat(F.lit("session"), F.regexp_extract(name, folder, 2), F.lit("_CH0_"), details_subset(F.regexp_extract(name, folder, 1)))
    return F.when(name.rlike(folder), made).when(name.rlike(coded), name)


def channel_suffix(path: Column) -> Column:
    """``CH1`` or ``U01CH4``: the first channel in a path, with its array."""
    pattern = r"(?:(U\d\d)\.)?([Cc][Hh]\d+)"
    return F.concat(F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2))


def last_token(name: Column) -> Column:
    return F.element_at(F.split(name, "_"), -1)


def without_last_token(name: Column) -> Column:
    """What stands before the last underscore; the whole name without one."""
    return F.coalesce(F.nullif(F.regexp_extract(name, "^(.*)_([^_]*)$", 1), F.lit("")), name)


def sanitised(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "_")


def numbered(i: Column, width: int) -> Column:
    """A whole number with leading zeros; wider ones stay whole."""
    text = i.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def without_channel(name: Column) -> Column:
    """A key without its last ``_chN``."""
    return F.regexp_replace(name, "_ch.$", "")
