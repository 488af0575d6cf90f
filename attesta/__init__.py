"""Field values with quoted evidence, extracted from bundles of documents on Spark."""

from attesta.settings import RunOptions, session, shared_folder, tune

__all__ = ["RunOptions", "session", "shared_folder", "tune"]
