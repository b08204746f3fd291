from logweir.cli import main

raise SystemExit(main())
