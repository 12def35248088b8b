"""tabreg: tabular regression analytics as plain DataFrame-to-DataFrame Spark steps."""

from tabreg.roles import Roles

__all__ = ["Roles"]
