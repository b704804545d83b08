"""noticeflow: a PySpark-native engine for tender-notice collections."""
