"""Text normalisation and naming rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """White space of any kind (no-break space and U+FEFF too) to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{FEFF}]+", " "))


def norm(c: Column) -> Column:
    return F.lower(squeeze(c))


def slug(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(out == "", F.lit("plot")).otherwise(out)


def rel_path(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("\\"), F.lit("/")))


def uri_fragment(c: Column) -> Column:
    """Percent-encoding of everything but letters, digits and -._~."""
    encoded = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def date_time(c: Column) -> Column:
    """First space to T; the text is not validated."""
    return F.regexp_replace(F.trim(c), r"^([^ ]*) ", "$1T")


def stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def local_name(c: Column) -> Column:
    """After the last #, then after the last /."""
    return F.substring_index(F.substring_index(c, "#", -1), "/", -1)


def rewrite_prefix(c: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The first matching (old, new) prefix is replaced."""
    out = c
    for old, new in reversed(prefixes):
        out = F.when(c.startswith(old), F.concat(F.lit(new), c.substr(F.lit(len(old) + 1), F.length(c)))).otherwise(out)
    return out


def class_of_predicate(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, "#", -1), "_", 1)


def predicate_parts(c: Column) -> Column:
    """(class, predicate): cut at #, else at the first underscore."""
    hash_ = F.struct(F.substring_index(c, "#", 1).alias("class"), F.substring_index(c, "#", -1).alias("predicate"))
    under = F.struct(F.regexp_extract(c, r"^([^_]*)_", 1).alias("class"), F.regexp_extract(c, r"^[^_]*_(.*)$", 1).alias("predicate"))
    return F.when(c.contains("#"), hash_).otherwise(under)


def class_key(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("%20"), F.lit("")))


def dataset_kind(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("bpmn"), "bpmn").when(low.contains("sysml"), "sysml").otherwise("generic")


def endpoint_dataset(url: Column) -> Column:
    """First path part of an endpoint URL, made fit for a folder name; generic without one."""
    part = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/([^/?#]+)", 1), r"[^A-Za-z0-9_.\-]+", "_")
    return F.when(part == "", "generic").otherwise(part)


def run_id(ts: Column, suffix: Column | None = None) -> Column:
    stamp = F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")
    return stamp if suffix is None else F.concat(stamp, F.lit("__"), F.regexp_replace(suffix, r"[^A-Za-z0-9_\-]+", "_"))


def fix_prefix(xml: Column, old: str = "ns0", new: str = "bpmn", namespace: str = "http://www.omg.org/spec/BPMN/20100524/MODEL") -> Column:
    """Rename a namespace prefix, if exactly this declaration is there."""
    out = F.replace(xml, F.lit(f'xmlns:{old}="{namespace}"'), F.lit(f'xmlns:{new}="{namespace}"'))
    out = F.replace(F.replace(out, F.lit(f"<{old}:"), F.lit(f"<{new}:")), F.lit(f"</{old}:"), F.lit(f"</{new}:"))
    return F.when(xml.contains(f'xmlns:{old}="{namespace}"'), out).otherwise(xml)


def fix_flags(xml: Column, names: tuple[str, ...] = ("isInterrupting", "isImmediate")) -> Column:
    """Give bare boolean attributes the value "true"."""
    for n in names:
        xml = F.regexp_replace(xml, rf'(\s){n}(?=[\s/>])(?!\s*=)', f'$1{n}="true"')
    return xml


def tokens(usage: Column) -> Column:
    """input, output and total tokens from a string map with any of the usual spellings; total falls back to the sum."""
    pick = lambda *names: F.coalesce(*(usage[n].try_cast("double").cast("long") for n in names), F.lit(0).cast("long"))
    i, o = pick("inputTokens", "input_tokens", "promptTokens", "prompt_tokens"), pick("outputTokens", "output_tokens", "completionTokens", "completion_tokens")
    t = pick("totalTokens", "total_tokens")
    return F.struct(i.alias("input"), o.alias("output"), F.when(t == 0, i + o).otherwise(t).alias("total"))
