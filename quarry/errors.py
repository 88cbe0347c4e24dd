"""Driver-side errors. Failures of single rows are outcome columns instead."""


class EngineError(Exception):
    """Base of the errors below; code is what an API would report."""

    code, status = "ENGINE_ERROR", 500


class IngestionError(EngineError):
    code, status = "INGESTION_FAILED", 500


class RightsError(EngineError):
    code, status = "RIGHTS_FORBIDDEN", 403


class NoEvidenceError(EngineError):
    code, status = "NO_EVIDENCE", 422


class GroundingError(EngineError):
    code, status = "UNGROUNDED_ANSWER", 502


class StaleCatalogError(EngineError):
    code, status = "CATALOG_STALE", 503
