"""noteloom: a Spark-native analytics engine for collections of linked documents."""
