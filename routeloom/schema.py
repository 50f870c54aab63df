"""Schemas of route evidence. Order is data: `ord` columns carry positions, rows themselves are unordered."""

SOURCE = "struct<file string, line int>"
MIDDLEWARE = f"struct<displayName string, canonicalSymbol string, callableKind string, source {SOURCE}, registrationScope string, orderingIndex int, resolutionStatus string, wrappedSymbols array<string>, shape string>"
AUTH = "struct<authStatus string, classificationBasis string, assurance string, enforcementAnalysis string, matchedEvidence string, confidence string, tags array<string>, roles array<string>, scopes array<string>, accepted boolean>"
ROUTE = f"ord long, method string, ginPath string, normalizedPath string, surfaceKind string, registrationKind string, middleware array<{MIDDLEWARE}>, finalHandler {MIDDLEWARE}, source {SOURCE}, pathConfidence string"
FINDING = f"id string, ruleId string, fingerprint string, severity string, confidence string, route string, source {SOURCE}, detail string, recommendation string, evidence string"
DIAGNOSTIC = f"code string, severity string, message string, source {SOURCE}, route string"
BUILD_CONTEXT = "struct<goos string, goarch string, moduleMode string, workspaceMode string, tags array<string>>"

#: Closed value sets (fixed values).
AUTH_STATUS = ("proven", "public", "unknown")
SEVERITIES = ("critical", "high", "medium", "low", "info")
TARGET_STATUS = ("ok", "failed", "inconclusive", "not-go-module")
METHODS = ("GET", "POST", "PUT", "PATCH", "HEAD", "OPTIONS", "DELETE", "CONNECT", "TRACE")
RISK = {"proven": 0, "unknown": 1, "public": 2}
SCHEMA_VERSION = "1.0"
TOOL_VERSION, RULESET_VERSION = "0.2.0", "1"
