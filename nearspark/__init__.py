"""nearspark: instance-based classification of large labelled tables with PySpark."""
