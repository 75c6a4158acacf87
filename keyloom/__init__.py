"""keyloom: a PySpark-native engine for corpora of nested animation documents and their training rows."""
