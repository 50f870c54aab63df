"""Canonical symbols, fingerprints and small text rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a symbol that hint at authentication (fixed values).
NAME_HINT = "(?i)auth|login|logout|token|session|verify|guard|require|permit|acl|jwt|bearer|csrf|xsrf|role|scope|rbac|api[-_]?key|apikey|protect|admin|sso|saml|oidc|signature|hmac|otp|mfa|whitelist|allowlist"
#: Symbols known to do something else (fixed values).
KNOWN_NON_AUTH = (
    "github.com/gin-gonic/gin.Recovery", "github.com/gin-gonic/gin.RecoveryWithWriter", "github.com/gin-gonic/gin.CustomRecovery",
    "github.com/gin-gonic/gin.Logger", "github.com/gin-gonic/gin.LoggerWithConfig", "github.com/gin-gonic/gin.LoggerWithFormatter",
    "github.com/gin-gonic/gin.LoggerWithWriter", "github.com/gin-contrib/cors.Default", "github.com/gin-contrib/cors.New",
    "github.com/gin-contrib/gzip.Gzip", "github.com/gin-contrib/requestid.New",
)


def package_of(symbol: Column) -> Column:
    """Text before the first `.(`, else before the last dot, else all of it."""
    return F.when(F.instr(symbol, ".(") > 0, F.substring_index(symbol, ".(", 1)).otherwise(F.regexp_replace(symbol, r"\.[^.]*$", ""))


def name_hint(symbol: Column) -> Column:
    return F.regexp_extract(symbol, "[^/]*$", 0).rlike(NAME_HINT) & ~symbol.isin(*KNOWN_NON_AUTH)


def known_non_auth(symbol: Column) -> Column:
    return symbol.isin(*KNOWN_NON_AUTH)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def candidate_id(symbol: Column) -> Column:
    return F.concat(F.lit("mw-"), F.substring(F.sha2(symbol, 256), 1, 12))


def severity_rank(severity: Column) -> Column:
    """Critical to info, then anything else."""
    out = F.lit(5)
    for i, s in reversed([*enumerate(("critical", "high", "medium", "low", "info"))]):
        out = F.when(severity == s, i).otherwise(out)
    return out


def exception_active(expires: Column, now: str) -> Column:
    """An exception holds through the whole of its last day. `now` is a literal, never the clock."""
    return F.coalesce(F.lit(now).cast("timestamp") < F.date_add(F.try_to_timestamp(expires, F.lit("yyyy-MM-dd")).cast("date"), 1).cast("timestamp"), F.lit(False))


def schema_major(version: Column) -> Column:
    """Text before the first dot; null without a dot or before it nothing."""
    return F.when(F.instr(version, ".") > 1, F.substring_index(version, ".", 1))


def metric_text(numerator: Column, denominator: Column, status: Column) -> Column:
    body = F.when(F.coalesce(denominator, F.lit(0)) == 0, "N/A").otherwise(F.format_string("%.1f%% (%d/%d)", 100.0 * numerator / denominator, numerator, denominator))
    return F.when((F.coalesce(denominator, F.lit(0)) == 0) | (status == "complete"), body).otherwise(F.concat(body, F.lit(" · "), status))


def repo_name(module: Column) -> Column:
    return F.when(module.endswith("/"), module).otherwise(F.substring_index(module, "/", -1))


def repo_url(module: Column) -> Column:
    return F.when(module.rlike(r"^(github\.com|gitlab\.com|bitbucket\.org)/[^/]*/"), F.concat(F.lit("https://"), F.substring_index(module, "/", 3)))


def servers(host: Column, base_path: Column, schemes: Column) -> Column:
    """One address for each scheme; https without any; the base path alone without a host."""
    given = F.coalesce(base_path, F.lit(""))
    base = F.when(given.startswith("/"), given).otherwise(F.concat(F.lit("/"), given))
    address = F.transform(F.when(F.size(F.coalesce(schemes, F.array())) > 0, schemes).otherwise(F.array(F.lit("https"))), lambda s: F.concat(s, F.lit("://"), host, base))
    return F.when(F.coalesce(host, F.lit("")) != "", address).when(given == "", F.array().cast("array<string>")).otherwise(F.array(base))


def valid_target_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~name.contains("..")


def valid_module_id(value: Column) -> Column:
    return value.rlike("^(root|module-[0-9a-fA-F]{16})$")


def module_id(path: Column) -> Column:
    """Stable and safe for folders: root, or a hash of the path within the repository."""
    return F.when(path == ".", "root").otherwise(F.concat(F.lit("module-"), F.substring(F.sha2(path, 256), 1, 16)))


def ordered_difference(a: Column, b: Column) -> Column:
    """Distinct elements of a that b lacks, in a's order; nulls as empty."""
    empty = F.array().cast("array<string>")
    return F.array_except(F.coalesce(a, empty), F.coalesce(b, empty))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)
