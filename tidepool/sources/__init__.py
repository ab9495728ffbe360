"""Where rows come from and go to: domain views, versioned tables, file trees."""
