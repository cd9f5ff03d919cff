"""Study screening on Spark: validate, vectorise, select, classify and report labelled text records."""

from studysift.config import ScreeningConfig

__all__ = ["ScreeningConfig"]
