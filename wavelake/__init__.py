"""Spark-native analytics for multichannel time series and longitudinal biomarkers."""
