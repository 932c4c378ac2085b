"""Character-bigram graphs and unsupervised word segmentation as Spark DataFrame plans."""
