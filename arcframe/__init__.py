"""arcframe: archives in, DataFrames out; DataFrames in, archives out."""

__version__ = "1.1.0"
