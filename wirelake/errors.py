"""Errors raised while a plan is being built (never per row)."""


class WirelakeError(Exception):
    """Base class of the errors below."""


class MissingColumnError(WirelakeError):
    def __init__(self, missing, available):
        self.missing = list(missing)
        super().__init__(f"missing columns {self.missing}; available: {sorted(available)}")


class InvalidTimeWindowError(WirelakeError, ValueError):
    def __init__(self, text):
        super().__init__(f"bad time window {text!r}; expected a number and one of ms, s, m, h, d")


class InvalidThresholdError(WirelakeError, ValueError):
    """A threshold, count or ratio outside its legal range."""


class InvalidValueError(WirelakeError, ValueError):
    """An argument that is not one of the accepted values."""


class EmptyTableError(WirelakeError):
    """Raised by the opt-in row check of a protocol view."""


def positive(name, value):
    if value is None or value <= 0:
        raise InvalidThresholdError(f"{name} must be greater than 0, got {value}")
    return value


def one_of(name, value, allowed):
    if value not in allowed:
        raise InvalidValueError(f"{name} must be one of {list(allowed)}, got {value!r}")
    return value
