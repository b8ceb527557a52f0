"""arborist: document-tree analytics and corpus preparation as Spark DataFrame transforms."""
