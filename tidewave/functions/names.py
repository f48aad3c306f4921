"""Channel, subject and label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of auxiliary channels; words in names of channels that quality control leaves out.
AUXILIARY = ("EOG", "ECG", "EKG", "EMG", "HEO", "VEO")
AUXILIARY_WORDS = ("veo", "heo", "eog", "ecg", "stim")


def folded(c: Column) -> Column:
    return F.lower(c)


def stripped_upper(c: Column) -> Column:
    return F.upper(F.trim(c))


def letters_upper(c: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def is_auxiliary(c: Column) -> Column:
    """One of the prefixes begins the name's letters and digits."""
    return letters_upper(c).rlike("^(" + "|".join(AUXILIARY) + ")")


def has_auxiliary_word(c: Column) -> Column:
    """One of the words stands anywhere in the name, in any case."""
    return F.lower(c).rlike("|".join(AUXILIARY_WORDS))


#: How names can be made alike, by name.
NORMALIZERS = {"folded": str.casefold, "stripped_upper": lambda s: s.strip().upper(), "letters_upper": lambda s: "".join(c for c in s.upper() if c.isascii() and c.isalnum())}


def _two(number: Column) -> Column:
    """A number in two digits at least; missing stays missing."""
    return F.when(number.isNotNull(), F.format_string("%02d", number.cast("int")))


def recording_path(root: str, subject: Column, day: Column, story: Column | None = None, suffix: str = "_eeg.npz") -> Column:
    """Where a recording of a story, or without one the day's rest, lies in a release: sub-01/ses-day1/eeg/sub-01_ses-day1_task-audio_desc-story01_eeg.npz.

    subject and story are numbers; the day can be story_day(story). A missing part gives no path.
    """
    sub, ses = F.concat(F.lit("sub-"), _two(subject)), F.concat(F.lit("ses-day"), day.cast("string"))
    what = F.lit("rest") if story is None else F.concat(F.lit("story"), _two(story))
    return F.concat(F.lit(root.rstrip("/") + "/"), sub, F.lit("/"), ses, F.lit("/eeg/"), sub, F.lit("_"), ses, F.lit("_task-audio_desc-"), what, F.lit(suffix))


def trailing_number(c: Column) -> Column:
    """The number at the end of "sub-07" and the like."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")


def story_day(c: Column, last: tuple[int, ...] = (17, 33, 50)) -> Column:
    """The day a story belongs to: 1 up to last[0], and so on; null outside."""
    out, low = F.lit(None).cast("int"), 1
    for day, high in enumerate(last, 1):
        out = F.when(c.between(low, high), F.lit(day)).otherwise(out)
        low = high + 1
    return out


def story_device(c: Column, last_early: int = 33) -> Column:
    return F.when(c <= last_early, "early").otherwise("late")


def cjk_count(c: Column) -> Column:
    """Characters from U+4E00 to U+9FFF."""
    return F.length(F.regexp_replace(c, "[^\\u4e00-\\u9fff]", ""))


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\\x1B\\[[0-9;]*[A-Za-z]", "")


def reasons(**flags: Column) -> Column:
    """The names of the flags that are set, as an array."""
    return F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]))


def joined_reasons(old: Column, new: Column) -> Column:
    """Union of a ;-joined list and an array: distinct, sorted, joined by ;."""
    had = F.filter(F.split(F.coalesce(old, F.lit("")), ";"), lambda x: (x != "") & (F.lower(x) != "nan"))
    return F.array_join(F.array_sort(F.array_union(had, new)), ";")
