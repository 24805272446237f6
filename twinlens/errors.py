"""Errors of the library."""


class TwinlensError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(TwinlensError):
    """A study, option or input table is not acceptable."""


class ClassificationModeError(TwinlensError):
    """The model cannot score the classes that it is asked for."""


class StageNotRunError(TwinlensError):
    """A stage needs something that was not loaded or run."""


class DegenerateMetricError(TwinlensError):
    """A metric has no value on this sample."""
