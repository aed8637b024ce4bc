"""gridloom: spatial point / region analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
