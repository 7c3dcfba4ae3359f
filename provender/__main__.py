from provender.plans.jobs import main

if __name__ == "__main__":
    main()
