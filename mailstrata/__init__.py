"""mailstrata: observation tables over corpora of e-mail messages, as Spark jobs."""

__version__ = "0.1.0"
