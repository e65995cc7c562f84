"""What each family of steps becomes: navigation, filters, reductions, branches and projections."""
