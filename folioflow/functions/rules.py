"""Rules of the pipeline around the texts: types, tones, providers, exports, uploads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_tone(document_type: Column, tone: Column) -> Column:
    """Papers are academic; a novel is never academic; textbooks keep theirs; unknown tones are of novels."""
    known = F.when(tone.isin("novel", "academic", "selfhelp", "classic", "fantasy"), tone).otherwise("novel")
    return F.when(document_type == "paper", "academic").when((document_type == "novel") & (tone == "academic"), "novel").otherwise(known)


#: Own wording of the style sheets by tone.
TONE_SHEETS = {
    "novel": "Narrative prose: natural, vivid Vietnamese; keep voices apart.",
    "academic": "Scholarly prose: precise terms, sober sentences, citations untouched.",
    "selfhelp": "Advice to a reader: direct, warm and clear.",
    "classic": "Classic literature: measured rhythm, period vocabulary.",
    "fantasy": "Fantasy: energetic, titles and ranks kept consistent.",
}


def tone_sheet(tone: Column) -> Column:
    table = F.create_map(*[x for k, v in TONE_SHEETS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[tone], F.lit(TONE_SHEETS["novel"]))


def export_kind(fmt: Column) -> Column:
    f = F.lower(fmt)
    return F.when(f.contains("epub"), "epub").when(f.contains("docx"), "docx").when(f.contains("html") | f.contains("pdf"), "html").when(f.contains("txt"), "txt").otherwise("unknown")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def upload_verdict(name: Column, n_bytes: Column, document_type: Column, limit: int = 100 * 1024 * 1024) -> Column:
    ext = extension(name)
    kind = F.when(F.coalesce(document_type, F.lit("")) != "", document_type).when(ext == "pdf", "paper").otherwise("novel")
    return (
        F.when(~name.rlike(r"^[^/\\]+$"), "bad_name")
        .when(~ext.isin("epub", "pdf", "docx", "txt", "md"), "bad_extension")
        .when(kind == "textbook", "bad_type")
        .when((kind == "paper") != (ext == "pdf"), "incompatible")
        .when(n_bytes == 0, "empty")
        .when(n_bytes > limit, "too_large")
        .otherwise("accepted")
    )


def key_list(keys: Column) -> Column:
    return F.filter(F.transform(F.split(keys, r"[\r\n;,]+", -1), lambda k: F.trim(k)), lambda k: k != "")


def masked(key: Column) -> Column:
    return F.when(F.length(key) <= 8, F.lit("****")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.substring(key, -4, 4)))


#: Words by which providers name a daily limit and a limit of rate; fixed values.
DAILY_WORDS = ("generaterequestsperday", "per_day", "perday", "per day", "daily")
RATE_WORDS = ("429", "quota", "rate limit", "resource_exhausted")


def _has_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def error_class(message: Column) -> Column:
    m = F.lower(message)
    return F.when(_has_any(m, DAILY_WORDS), "daily").when(_has_any(m, RATE_WORDS), "rate").when(m == "", "none").otherwise("other")


def retry_after(provider: Column, message: Column, header: Column) -> Column:
    """Seconds to wait: what the message says, then the header, two more than either; else the provider's default."""
    said = F.nullif(F.regexp_extract(message, r"(?i)retry in\s+([0-9.]+)\s*s", 1), F.lit("")).try_cast("double")
    default = F.when(provider == "gemini", 35.0).otherwise(25.0)
    return F.coalesce(said + 2, header.try_cast("double") + 2, default)


def key_status(probes: DataFrame) -> DataFrame:
    """account, status: error only if every probe was refused or failed; else the best of ok, daily, rpm, warning."""

    def any_of(outcome: str) -> Column:
        return F.bool_or(F.col("outcome") == outcome)

    valid = F.bool_or(F.coalesce(~F.col("outcome").isin("invalid", "error", "other"), F.lit(False)))
    status = F.when(~valid, "error").when(any_of("ok"), "ok").when(any_of("daily"), "daily").when(any_of("rpm"), "rpm").otherwise("warning")
    return probes.groupBy("account").agg(status.alias("status"))


#: Model names by provider, older names and what they stand for, and the models tried after the chosen one; fixed values.
DEFAULT_MODELS = {"gemini": "gemini-3.5-flash", "deepseek": "deepseek-chat", "openai_compatible": "deepseek-chat", "openai": "gpt-4o-mini"}
MODEL_ALIASES = {"gemini-2.5-flash": "gemini-3.5-flash", "gemini-1.5-flash": "gemini-3.5-flash", "gemini-2.0-flash": "gemini-3.5-flash", "gemini-2.5-pro": "gemini-3.1-pro-preview", "gemini-1.5-pro": "gemini-3.1-pro-preview"}
NEXT_MODELS = ("gemini-3.5-flash", "gemini-3.5-flash-lite", "gemini-3.1-flash-lite", "gemini-flash-lite-latest", "gemini-3.7-flash")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def model_of(provider: Column, model: Column) -> Column:
    """The model of a call: an older name's successor (gemini), the given one, or the provider's default."""
    given = F.nullif(model, F.lit(""))
    renamed = F.when(provider == "gemini", _lookup(MODEL_ALIASES, given))
    return F.coalesce(renamed, given, _lookup(DEFAULT_MODELS, provider), F.lit("free-fallback"))


def candidate_models(provider: Column, model: Column) -> Column:
    """The models that a call tries in order, each once; only gemini has more than one."""
    first = F.array(model_of(provider, model))
    return F.when(provider == "gemini", F.array_distinct(F.concat(first, F.array(*[F.lit(m) for m in NEXT_MODELS])))).otherwise(first)


#: Metadata that names no title or author; fixed values.
NO_TITLES = ("untitled", "latex", "tex", "document", "manuscript", "draft", "none", "arxiv", "unknown", "default")
NO_AUTHORS = ("unknown", "author", "tex", "latex", "none", "anonymous", "user", "admin")


def accepted_title(title: Column) -> Column:
    """A title of a file's metadata if it names one (over four characters), else an empty string."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when((F.length(t) > 4) & ~_has_any(F.lower(t), NO_TITLES), t).otherwise("")


def accepted_author(author: Column) -> Column:
    a = F.trim(F.coalesce(author, F.lit("")))
    return F.when((F.length(a) > 2) & ~_has_any(F.lower(a), NO_AUTHORS), a).otherwise("")


#: The form of a Vietnamese textbook's file name, and words of its title that name its author; fixed values.
TEXTBOOK_NAME = r"(?iu)^(GI[AÁ]O\s+TR[IÌ]NH\s+[^(\n]+)"
STATE_TITLES, STATE_AUTHOR, SEVERAL_AUTHORS = ("chu nghia xa hoi", "triet hoc", "giao trinh"), "Bộ Giáo dục và Đào tạo", "Nhiều tác giả"


def textbook_title(meta: Column, file_name: Column) -> Column:
    """The metadata's title, or that of the file name without what stands in brackets; capitals only become title case."""
    named = F.regexp_extract(file_name, TEXTBOOK_NAME, 1)
    clean = F.when(named != "", F.trim(named)).otherwise(file_name)
    titled = F.when((F.upper(clean) == clean) & (F.lower(clean) != clean), F.initcap(clean)).otherwise(clean)
    return F.coalesce(F.nullif(F.trim(meta), F.lit("")), titled)


def textbook_author(meta: Column, title: Column) -> Column:
    state = _has_any(F.lower(title), STATE_TITLES)
    return F.coalesce(F.nullif(F.trim(meta), F.lit("")), F.when(state, STATE_AUTHOR).otherwise(SEVERAL_AUTHORS))


def role_parts(text: Column) -> Column:
    """role, first and second person from a form such as 'friend - tớ / cậu'; defaults where parts lack."""
    parts = F.filter(F.transform(F.split(text, r"\s*[-–/,]\s*", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.coalesce(F.get(parts, 0), F.lit("")).alias("role"), F.coalesce(F.get(parts, 1), F.lit("tôi")).alias("first"), F.coalesce(F.get(parts, 2), F.lit("cậu")).alias("second"))
