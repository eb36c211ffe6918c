"""Multi-step plans: preprocessing, filtering, walk-forward training, back-test report."""
