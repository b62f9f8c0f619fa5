"""Errors of the library; all derive from CinnabarError."""


class CinnabarError(Exception):
    """Any error of the library."""


class StoreError(CinnabarError):
    """A record table can't be read or written."""


class ValidationError(CinnabarError):
    """An input isn't what it should be."""


class AnalysisError(CinnabarError):
    """Code can't be analysed, or a group can't be split."""


class ConfigurationError(CinnabarError):
    """Something that must be set isn't."""
