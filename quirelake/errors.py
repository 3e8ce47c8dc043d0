"""Errors raised on the driver; workers report theirs in an ``error`` column."""


class ConversionError(Exception):
    """Base of the errors below."""


class MissingDependency(ConversionError):
    """A library or program that a source needs is not installed."""


class OcrError(ConversionError):
    """A recogniser failed or doesn't support what was asked of it."""


class ArchiveError(ConversionError):
    """A built archive is not valid."""


class Cancelled(ConversionError):
    """The user stopped the conversion."""
