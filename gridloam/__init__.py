"""gridloam: gridded daily time series and document analytics on PySpark."""
