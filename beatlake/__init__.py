"""beatlake: Spark-native analytics for long event and signal recordings."""

__version__ = "0.1.0"
