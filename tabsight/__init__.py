"""tabsight: automated table analysis and modelling on Spark DataFrames."""
__version__ = "0.1.0"
